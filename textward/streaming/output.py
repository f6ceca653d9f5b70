"""Answers checked while they stream in: chunks of a stream in, text that may be shown out.

The last HOLDBACK characters wait until more text shows whether a secret begins in them. What was shown stays in view
(TAIL characters), so a secret across the seam is still noticed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textward.functions.patterns import Registry
from textward.functions.text import STOPWORDS
from textward.operators import exfil
from textward.operators import output as O
from textward.operators import spans as S

HOLDBACK = 256
TAIL = 512
MIN_OVERLAP_CHARS = 200
MIN_CHUNK = 48
_SEAM = 32
DELTA = "stream_id string, seq int, text string, blocked boolean, reason string, replacement string, leaked boolean, categories array<string>, overlap double"
_STATE = "state string"


@dataclass
class State:
    """What a stream has behind it; plain values, so that it can be stored."""

    buffer: str = ""
    tail: str = ""
    emitted: int = 0
    raw: int = 0
    waiting: str = ""
    words: list[str] = field(default_factory=list)
    pii: list[str] = field(default_factory=list)
    leaked: bool = False
    reason: str | None = None
    replacement: str | None = None
    categories: list[str] = field(default_factory=list)
    overlap: float = 0.0


def _words(text: str) -> set[str]:
    import re
    import unicodedata

    return set(re.findall(r"\w+", unicodedata.normalize("NFKC", text.lower())))


@dataclass(frozen=True)
class Guard:
    """Decides on a stream; `step` takes a state and a chunk (None: the end) to the next state and a delta."""

    prompt: str | None = None
    registry: Registry = field(default_factory=Registry)
    policy: exfil.Policy | None = field(default_factory=exfil.Policy)
    holdback: int = HOLDBACK
    tail: int = TAIL
    threshold: float = O.OVERLAP
    min_overlap_chars: int = MIN_OVERLAP_CHARS
    max_chars: int | None = 200_000
    redact_pii: bool = True
    literals: tuple[str, ...] = ()
    canaries: tuple[str, ...] = ()
    min_chunk: int = MIN_CHUNK

    def prompt_words(self) -> set[str]:
        return {w for w in _words(self.prompt or "") - set(STOPWORDS) if len(w) > 2}

    def _block(self, s: State, reason: str, replacement: str, categories, straddles: bool) -> dict:
        s.reason, s.replacement, s.buffer = reason, replacement, ""
        s.categories = sorted(set(categories))
        s.leaked = straddles and s.emitted > 0
        return self._delta(s, "")

    def _delta(self, s: State, text: str) -> dict:
        return dict(text=text, blocked=s.reason is not None, reason=s.reason, replacement=s.replacement, leaked=s.leaked, categories=s.categories if s.reason else s.pii, overlap=s.overlap)

    def feed(self, s: State, chunk: str | None) -> dict:
        """`step` for chunks of any size: small ones wait until min_chunk characters have come, or the end."""
        s.waiting += chunk or ""
        if s.reason is None and chunk is not None and len(s.waiting) < self.min_chunk:
            return self._delta(s, "")
        ready, s.waiting = s.waiting, ""
        delta = self.step(s, ready)
        if chunk is None:
            last = self.step(s, None)
            delta = last | {"text": delta["text"] + last["text"]}
        return delta

    def step(self, s: State, chunk: str | None) -> dict:
        if s.reason is not None or chunk == "":
            return self._delta(s, "")
        asked = self.prompt_words()
        if chunk is not None:
            before = s.buffer[-_SEAM:]
            s.buffer += chunk
            s.raw += len(chunk)
            s.words = sorted(set(s.words) | (_words(before + chunk) & asked))
            if self.max_chars is not None and s.raw > self.max_chars:
                return self._block(s, "oversized", O.TOO_LARGE, (), False)
        final = chunk is None
        edge, view = len(s.tail), s.tail + s.buffer
        secrets, personal = S.compiled(self.registry)
        spans = [x for x in S.find_in(view, secrets, personal, list(self.literals), self.canaries) if x[1] > edge]
        hidden = [x for x in spans if x[3] == S.SECRET]
        pii = [x for x in spans if x[3] == S.PERSONAL] if self.redact_pii else []
        urls = [u for u in exfil.find_in(view, self.policy) if u["end"] > edge] if self.policy else []
        s.pii = sorted(set(s.pii) | {x[2] for x in pii})
        if hidden:
            return self._block(s, "secret", O.BLOCKED, (x[2] for x in hidden), any(x[0] < edge for x in hidden))
        if worst := [u for u in urls if u["severity"] == "block"]:
            return self._block(s, "exfil", O.EXFIL_BLOCKED, (r for u in worst for r in u["reasons"]), any(u["start"] < edge for u in worst))
        s.overlap = round(len(s.words) / len(asked), 3) if asked else 0.0
        if asked and (final or s.raw >= self.min_overlap_chars) and s.overlap >= self.threshold:
            return self._block(s, "system_prompt_overlap", O.BLOCKED, (), False)
        return self._emit(s, view, edge, pii, urls, final)

    def _emit(self, s: State, view: str, edge: int, pii: list, urls: list, final: bool) -> dict:
        cut = len(view) if final else max(edge, len(view) - self.holdback)
        for a, b in [x[:2] for x in pii] + [(u["start"], u["end"]) for u in urls]:
            cut = a if a < cut < b else cut
        if cut <= edge:
            return self._delta(s, "")
        text = redact(view[edge:cut], [(max(a - edge, 0), b - edge, c, p) for a, b, c, p in pii if b <= cut])
        if any(u["severity"] != "notice" and u["end"] <= cut for u in urls):
            text = neutralize(text, exfil.find_in(text, self.policy))
        if s.emitted and (any(x[0] < edge for x in pii) or any(u["start"] < edge and u["severity"] != "notice" for u in urls)):
            s.leaked = True
        shown = view[edge:cut]
        s.buffer, s.emitted = s.buffer[len(shown) :], s.emitted + len(shown)
        keep = max(self.tail, self.holdback)
        s.tail = (s.tail + shown)[-keep:] if keep else ""
        return self._delta(s, text)


def _replaced(text: str, parts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in parts:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def redact(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """`spans.redact` for one string."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], s[3], s[2])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif s[1] - s[0] > kept[-1][1] - kept[-1][0]:
            kept[-1] = s
    return _replaced(text, [(a, b, f"[REDACTED:{c.upper()}]") for a, b, c, _ in kept])


def neutralize(text: str, found: list[dict]) -> str:
    """`exfil.neutralize` for one string."""
    import re

    parts: list[tuple[int, int, str]] = []
    for u in sorted((u for u in found if u["severity"] != "notice"), key=lambda u: u["start"]):
        if parts and u["start"] < parts[-1][1]:
            continue
        label = re.match(r"!?\[([^\]]*)\]", text[u["start"] : u["end"]])
        name = label[1].strip() if label else ""
        gone = exfil.EMBED_GONE if u["auto_fetch"] else f"[{name} — {exfil.LINK_GONE}]" if name else f"[{exfil.LINK_GONE}]"
        parts.append((u["start"], u["end"], gone))
    return _replaced(text, parts)


def run(guard: Guard, chunks: list[str | None], state: State | None = None) -> tuple[list[dict], State]:
    """Deltas of chunks in order; small ones wait until MIN_CHUNK characters have come."""
    s = state or State()
    return [guard.feed(s, c) for c in chunks], s


def result(deltas: list[dict]) -> dict:
    """What a whole stream came to: all text shown, and the decision, which is that of its last delta."""
    if not deltas:
        return Guard()._delta(State(), "")
    return deltas[-1] | {"text": "".join(d["text"] for d in deltas), "leaked": any(d["leaked"] for d in deltas)}


def results(deltas: DataFrame) -> DataFrame:
    """`result` for a table of deltas: (stream_id, text, blocked, reason, replacement, leaked, categories, overlap)."""
    from pyspark.sql import functions as F

    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text")
    last = F.max_by(F.struct("blocked", "reason", "replacement", "categories", "overlap"), "seq").alias("last")
    out = deltas.groupBy("stream_id").agg(shown, F.bool_or("leaked").alias("leaked"), last)
    return out.select("stream_id", "text", "last.blocked", "last.reason", "last.replacement", "leaked", "last.categories", "last.overlap")


def _rows(guard: Guard, stream_id: str, pdf: pd.DataFrame, s: State) -> Iterator[pd.DataFrame]:
    out = []
    for r in pdf.sort_values("seq").itertuples():
        steps = [guard.feed(s, r.chunk)] if r.chunk else []
        if getattr(r, "last", False):
            steps.append(guard.feed(s, None))
        if steps:  # the last chunk's row holds what the end lets through, too
            out.append((r.seq, steps[-1] | {"text": "".join(d["text"] for d in steps)}))
    frame = pd.DataFrame([{"stream_id": stream_id, "seq": seq, **d} for seq, d in out], columns=[f.split()[0] for f in DELTA.split(", ")])
    yield frame


def batch(chunks: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """Deltas of whole streams; chunks has stream_id, seq, chunk, last."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return next(_rows(guard, key[0], pdf, State()))

    return chunks.groupBy("stream_id").applyInPandas(one, DELTA)


def stream(chunks: DataFrame, guard: Guard = Guard(), timeout_ms: int = 600_000) -> DataFrame:
    """Deltas of a streaming table of chunks, in order of seq inside a micro-batch. An idle stream's state goes after the timeout."""
    import json

    def one(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = State(**json.loads(state.get[0])) if state.exists else State()
        pdf = pd.concat(list(frames))
        yield from _rows(guard, key[0], pdf, s)
        if "last" in pdf and bool(pdf["last"].any()):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(asdict(s)),))
            state.setTimeoutDuration(timeout_ms)

    return chunks.groupBy("stream_id").applyInPandasWithState(one, DELTA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
