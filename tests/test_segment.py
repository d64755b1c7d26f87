import pytest
from pyspark.sql import functions as F

from engramspark.config import BufferConfig
from engramspark.functions.text import chars_div_4
from engramspark.operators import segment as S
from engramspark.streaming.ingest import Buffer, is_gap

TURNS = "session_id long, turn_idx long, role string, content string, ts_raw string"


def at(minutes):
    return f"2026-04-14T{10 + minutes // 60:02d}:{minutes % 60:02d}:00Z"


def turns(sizes, times=None):
    return [(1, i, "user", "x" * n, times[i] if times else None) for i, n in enumerate(sizes)]


def scripted(points):
    return lambda buffer: F.array(*[F.lit(p) for p in points]).cast("array<int>")


CASES = {
    "one turn": (turns([5]), [], [], 1),
    "gap takes the turn after it": (turns([5, 5], [at(0), at(35)]), [], [(2, "gap")], 0),
    "no gap": (turns([5, 5], [at(0), at(5)]), [], [], 2),
    "offset zone": (turns([5, 5], ["2026-04-14T10:00:00+08:00", "2026-04-14T10:35:00+08:00"]), [], [(2, "gap")], 0),
    "exactly 30": (turns([5, 5], [at(0), at(30)]), [], [], 2),
    "back in time": (turns([5, 5], [at(40), at(0)]), [], [], 2),
    "bad time": (turns([5, 5], [at(0), "soon"]), [], [], 2),
    "chain": (turns([5] * 4, [at(0), at(35), at(60), at(95)]), [], [(2, "gap"), (2, "gap")], 0),
    "hard": (turns([820] * 10), [], [(10, "hard")], 0),
    "split 5": (turns([400] * 6), [5], [(5, "soft")], 1),
    "split 3 and 6": (turns([400] * 8), [3, 6], [(3, "soft"), (3, "soft")], 2),
    "split at the end": (turns([400] * 6), [6], [(6, "soft")], 0),
    "invalid splits": (turns([400] * 6), [0, -1, 100], [], 6),
    "gap before hard": (turns([8200, 5], [at(0), at(60)]), [], [(1, "hard")], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_batch_and_stream_folds(spark, name):
    rows, points, cells, left = CASES[name]
    folded = S.fold(spark.createDataFrame(rows, TURNS), estimator=chars_div_4, detector=scripted(points) if points else S.no_split)
    got = S.cells(folded).orderBy("cell_seq").collect()
    assert [(r.n_turns, r.reason) for r in got] == cells
    assert [r.cell_type for r in got] == ["fragmented" if reason == "hard" else "fact" for _, reason in cells]
    assert [r.cell_id for r in got] == [f"C_{k + 1:03d}" for k in range(len(cells))]
    assert [r.linked_prev for r in got] == [None, *[f"C_{k + 1:03d}" for k in range(len(cells) - 1)]][: len(cells)]
    assert len(S.hot_zone(folded).first().hot_zone) == left
    buffer = Buffer(BufferConfig(), lambda s: len(s) // 4, lambda turns: points)
    assert [(len(part), reason) for t in rows for _, _, reason, part in buffer.add(t[1:])] == cells
    assert len(buffer.turns) == left


def test_checks_happen_once_for_each_multiple():
    asked = []
    buffer = Buffer(BufferConfig(), lambda s: len(s) // 4, lambda turns: asked.append(len(turns)) or [])
    for n in (400, 400, 400, 400, 400, 48, 48, 400, 400, 400, 400, 400):
        list(buffer.add((0, "user", "x" * n, None)))
    assert asked == [6, 12]


STAMPS = [
    ("2026-04-14T10:00:00", "2026-04-14T12:00:00Z", False), ("2026-04-14T10:00:00", "2026-04-14T12:00:00", True), ("2024", "2024-03", False), ("00:00", "01:00", False),
    ("20240101T000000Z", "20240101T010000Z", True), ("2024-01-01", "2024-01-02", True), ("2024-01-01T00:00", "2024-01-01T00:30:00.000001", True), ("2024-01-01T10:00+08:00", "2024-01-01T02:31:00Z", True),
    ("2024-01-01T10:00-0530", "2024-01-01T15:31+00", False), ("2024-13-01", "2024-12-01", False), (None, "2024-01-01", False), ("2024-01-01 10:00:00.5", "2024-01-01 10:30:00.4", False), ("2024-02-30", "2024-03-02", False),
]


def test_times_are_read_alike(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _ in STAMPS], "a string, b string")
    got = rows.select(S.is_gap(S.moment_of(rows, "a"), S.moment_of(rows, "b"), 30)).collect()
    assert [r[0] for r in got] == [w for _, _, w in STAMPS] == [is_gap(a, b, 30) for a, b, _ in STAMPS]


def test_null_contents_do_not_silence_a_session(spark):
    rows = [(1, 0, "user", "x" * 100, None), (1, 1, None, None, None), (1, 2, "user", "x" * 3000, None)]
    cell = S.cells(S.fold(spark.createDataFrame(rows, TURNS))).first()
    assert (cell.n_turns, cell.reason) == (3, "hard") and "[user]: \n" in cell.raw_text


def test_long_buffers_split_without_a_model(spark):
    rows = spark.createDataFrame([([{"content": "x" * 9000}],), ([{"content": "x" * 5000}] * 3,), ([{"content": "x"}],)], "t array<struct<content:string>>")
    assert [r[0] for r in rows.select(S.split_long(F.col("t"))).collect()] == [[1], [2], []]


def test_numbers_go_on_from_the_largest_id(spark):
    rows = spark.createDataFrame([("s", "C_003"), ("s", "C_001"), ("t", "other")], "session_id string, cell_id string")
    assert {r.session_id: r.next for r in S.next_cell_number(rows).collect()} == {"s": 4, "t": 1}


def test_stream_equals_batch(spark, tmp_path):
    from engramspark.streaming.ingest import ingest

    TURNS = "session_id string, turn_idx long, role string, content string, ts_raw string"  # noqa: N806
    rows = [(f"s{s}", i, "user", None if i == 3 else "x" * (150 * (1 + (i * s) % 4)), at(7 * i + (40 if i % 5 == 4 else 0))) for s in range(1, 6) for i in range(20)]
    config = BufferConfig(soft=512, hard=1500)
    batch = S.cells(S.fold(spark.createDataFrame(rows, TURNS), config, detector=S.split_all))
    folder = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, TURNS)
    for k in range(2):
        frame.filter((F.col("turn_idx") >= 10 * k) & (F.col("turn_idx") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(folder)
        q = ingest(spark.readStream.schema(TURNS).parquet(folder), config, detector=lambda turns: [len(turns)]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, batch.select(got.columns).collect()), key=repr)


def test_stream_cells_of_a_file_a_folder_and_an_empty_table(spark, tmp_path):
    from engramspark.plans.queries import QUERIES

    rows = spark.createDataFrame([(1 + k % 3, k, "user", "x" * 900) for k in range(30)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one/conversations.parquet")
    want, *got = (sorted(map(tuple, QUERIES[q](spark, f"{tmp_path}/{d}").collect()), key=repr) for q, d in (("segment_cells", "many"), ("stream_cells", "many"), ("stream_cells", "one")))
    assert want and got == [want, want]
    assert not QUERIES["stream_cells"](spark, f"{tmp_path}/none").collect()
