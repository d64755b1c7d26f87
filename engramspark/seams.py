"""Seams for models: what may be plugged in, and how a batch of rows goes through one client per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import BUFFER, BufferConfig
from .functions.text import ROLES


class Timed(NamedTuple):
    """A reply, milliseconds in all and to its first piece."""

    text: str
    total_ms: float
    first_ms: float


class ChatClient(Protocol):
    """A chat and embedding service."""

    def chat(self, messages: list[dict[str, str]], **options) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _messages(task: str, text: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": task}, {"role": "user", "content": text}]


_LIST = {"type": "array", "items": {"type": "string"}}
#: JSON schemas of replies, for services that take them.
CELL_SCHEMA = {"type": "object", "required": ["summary", "keywords", "entities", "cell_type", "confidence"], "properties": {"summary": {"type": "string"}, "keywords": _LIST, "entities": _LIST, "causal_deps": _LIST, "cell_type": {"enum": ["fact", "constraint", "preference", "task"]}, "confidence": {"type": "number"}}}
META_SCHEMA = {"type": "object", "required": ["summary", "keywords", "entities"], "properties": {"summary": {"type": "string"}, "keywords": _LIST, "entities": _LIST, "confidence": {"type": "number"}}}


def extraction_prompt(text: str) -> list[dict[str, str]]:
    return _messages("Describe the passage as a JSON object with summary, keywords (at most 8), entities (at most 5), causal_deps, cell_type (fact, constraint, preference or task) and confidence (0 to 1). Say nothing else.", text)


def meta_prompt(text: str) -> list[dict[str, str]]:
    return _messages("Merge the digest so far and the new summaries into one digest of the whole conversation. Reply with a JSON object with summary, keywords, entities and confidence.", text)


def boundary_prompt(text: str) -> list[dict[str, str]]:
    return _messages("The turns are numbered from 1. List after which of them the topic changes for good, as JSON: {\"split_indices\": [...]}. An empty list means that they belong together.", text)


def rewrite_prompt(text: str) -> list[dict[str, str]]:
    return _messages("Rewrite the question so that it can be understood without the conversation before it. Reply with the question alone.", text)


def judge_prompt(text: str) -> list[dict[str, str]]:
    return _messages("Grade the answer against the truth with a number from 0 to 1.", text)


def answer_prompt(text: str) -> list[dict[str, str]]:
    return _messages("Answer the last question from the conversation, in a few words.", text)


class HttpChatClient:
    """A client of services with ``/chat/completions`` and ``/embeddings``.  ``post(url, body, stream)`` yields lines or one JSON text."""

    def __init__(self, base_url: str, model: str, key: str = "", json_schema: bool = False, post: Callable[[str, dict, bool], Iterator[str]] | None = None):
        self.base_url, self.model, self.key, self.json_schema = base_url.rstrip("/"), model, key, json_schema
        self.post = post or self._post

    def _post(self, url: str, body: dict, stream: bool) -> Iterator[str]:
        import json
        import urllib.request

        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            if stream:
                for line in answer:
                    yield line.decode()
            else:
                yield answer.read().decode()

    def _body(self, messages: list[dict[str, str]], options: dict) -> dict:
        """The request; services without JSON schemas are not sent any."""
        wanted = {k: v for k, v in options.items() if k != "response_format" or self.json_schema or (v or {}).get("type") != "json_schema"}
        return {"model": self.model, "messages": messages, **wanted}

    def chat(self, messages: list[dict[str, str]], **options) -> str:
        import json

        text = "".join(self.post(f"{self.base_url}/chat/completions", self._body(messages, options), False))
        return json.loads(text)["choices"][0]["message"]["content"] or ""

    def pieces(self, messages: list[dict[str, str]], **options) -> Iterator[tuple[float, str]]:
        """Arrival time and text of each piece of a streamed reply."""
        import json
        import time

        for event in self.post(f"{self.base_url}/chat/completions", {**self._body(messages, options), "stream": True}, True):
            payload = event.strip().removeprefix("data:").strip()
            if payload in ("", "[DONE]"):
                continue
            for choice in json.loads(payload).get("choices") or ():
                if text := (choice.get("delta") or {}).get("content"):
                    yield time.perf_counter(), text

    def timed(self, messages: list[dict[str, str]], **options) -> Timed:
        """A reply with its times; where streaming fails, both are the time until then and the reply comes in one piece."""
        import time

        begun = time.perf_counter()
        try:
            got = list(self.pieces(messages, **options))
        except Exception:
            lost = 1000 * (time.perf_counter() - begun)
            return Timed(self.chat(messages, **options), lost, lost)
        ended = time.perf_counter()
        return Timed("".join(text for _, text in got), 1000 * (ended - begun), 1000 * ((got[0][0] if got else ended) - begun))

    def embed(self, texts: list[str]) -> list[list[float]]:
        import json

        text = "".join(self.post(f"{self.base_url}/embeddings", {"model": self.model, "input": texts}, False))
        return [x["embedding"] for x in json.loads(text)["data"]]


def chat_column(rows: DataFrame, text_col: str, reply_col: str, client: Callable[[], ChatClient], prompt: Callable[[str], list[dict[str, str]]], degrade: bool = True, empty: bool = True) -> DataFrame:
    """``rows`` with the client's reply to each text; one client a task.

    With ``degrade`` a failed call gives null.  Without ``empty`` a null text gets no call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = client()
        for b in batches:
            out = []
            for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
                if text is None and not empty:
                    out.append(None)
                    continue
                try:
                    out.append(c.chat(prompt(text or "")))
                except Exception:
                    if not degrade:
                        raise
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, reply_col])

    return rows.mapInArrow(run, rows.withColumn(reply_col, F.lit(None).cast("string")).schema)


def embed_column(rows: DataFrame, text_col: str, vector_col: str, client: Callable[[], ChatClient]) -> DataFrame:
    """``rows`` with an embedding of each text; null for a batch whose call fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = client()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            try:
                out = c.embed(texts)
            except Exception:
                out = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, vector_col])

    return rows.mapInArrow(run, rows.withColumn(vector_col, F.lit(None).cast("array<float>")).schema)


def answered(rows: DataFrame, text_col: str, prefix: str, client: Callable[[], ChatClient]) -> DataFrame:
    """``rows`` with <prefix>_answer, _latency_ms and _ttft_ms of each prompt; an empty prompt gets no call.

    Clients without ``timed`` are timed as a whole; a failed call gives an empty answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        c = client()
        for b in batches:
            out = []
            for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
                begun, got = time.perf_counter(), Timed("", 0.0, 0.0)
                if text:
                    try:
                        if hasattr(c, "timed"):
                            got = c.timed(answer_prompt(text))
                        else:
                            reply = c.chat(answer_prompt(text))
                            got = Timed(reply, *[1000 * (time.perf_counter() - begun)] * 2)
                    except Exception:
                        got = Timed("", *[1000 * (time.perf_counter() - begun)] * 2)
                out.append(got)
            more = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, f"{prefix}_answer", f"{prefix}_latency_ms", f"{prefix}_ttft_ms"])

    zero = F.lit(0.0)
    return rows.mapInArrow(run, rows.withColumn(f"{prefix}_answer", F.lit(None).cast("string")).withColumns({f"{prefix}_latency_ms": zero, f"{prefix}_ttft_ms": zero}).schema)


def judged(rows: DataFrame, prefix: str, truth_col: str, client: Callable[[], ChatClient]) -> DataFrame:
    """``rows`` with <prefix>_judge_score of <prefix>_answer; null without an answer, 0 where no number comes back."""
    from .functions.text import judge_score

    answer = F.col(f"{prefix}_answer")
    both = F.when(F.length(answer) > 0, F.concat(F.lit("Truth: "), F.coalesce(F.col(truth_col), F.lit("")), F.lit("\nAnswer: "), answer))
    rows = chat_column(rows.withColumn("both_", both), "both_", "reply_", client, judge_prompt, empty=False)
    return rows.withColumn(f"{prefix}_judge_score", F.when(F.col("both_").isNotNull(), judge_score(F.col("reply_")))).drop("both_", "reply_")


def boundary_detector(client: Callable[[], ChatClient], config: BufferConfig = BUFFER) -> Callable[[list[tuple]], list[int]]:
    """A detector for folds in Python: long buffers are cut by rule, others as the client says; no cut where it fails."""
    import json
    import re

    held: list[ChatClient] = []

    def detect(turns: list[tuple]) -> list[int]:
        if not turns:
            return []
        if sum(len(t[2]) for t in turns) > config.detector_chars:
            return [max(1, len(turns) - 1)]
        if not held:
            held.append(client())
        lines = [f"{k}. [{t[1] if t[1] in ROLES else 'user'}]: {t[2]}" for k, t in enumerate(turns, 1)]
        try:
            reply = held[0].chat(boundary_prompt("\n".join(lines)))
            found = json.loads(re.search(r"(?s)\{.*\}|\[.*\]", reply).group())
            points = found if isinstance(found, list) else next((found[k] for k in ("split_indices", "split_points", "boundaries") if found.get(k)), [])
            return sorted({int(p) for p in points if 0 < int(p) <= len(turns)})
        except Exception:
            return []

    return detect
