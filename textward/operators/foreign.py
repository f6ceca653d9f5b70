"""Identifiers of one owner in texts meant for another: exact containment of many literals at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shorter literals are parts of ordinary words.
LEAST_CHARS = 4
#: Bytes of literals in one automaton, sent to every task; more go block by block.
BLOCK_BYTES = 8 << 20


def _blocks(literals: DataFrame, block_bytes: int) -> Iterator[list]:
    size = literals.agg(F.sum(F.octet_length("literal") + 64).alias("b")).first().b or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        if rows := literals.where(F.pmod(F.xxhash64("literal"), F.lit(n)) == k).collect():
            yield rows


def found(texts: DataFrame, literals: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", principal_col: str | None = None, literal_id: str = "literal_id", literal_col: str = "literal", owner_col: str | None = None, least: int = LEAST_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, literal_id) for each text and literal of at least so many characters that stands in it, as it is written.

    With principal_col and owner_col, a text's own principal's literals don't count; one without owner is
    foreign to all, and all are to a text without principal.  Each pair stands once for each row of texts.
    Literals are sent out in blocks of a set size; a text meets all of a block in one pass (Aho-Corasick).
    """
    none = F.lit(None).cast("string")
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(principal_col).cast("string") if principal_col else none).alias("principal"))
    wanted = literals.select(F.col(literal_id).alias("number"), F.col(literal_col).alias("literal"), (F.col(owner_col).cast("string") if owner_col else none).alias("owner"))
    wanted = wanted.where(F.length("literal") >= least).distinct()
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((source, "id"), (wanted, "number"))]
    schema = f"`{id_col}` {kinds[0]}, `{literal_id}` {kinds[1]}"
    kind = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
    out = None
    for rows in _blocks(wanted, block_bytes):
        sent = texts.sparkSession.sparkContext.broadcast([(r.literal, r.number, r.owner) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, of = ahocorasick.Automaton(), {}
            for literal, number, owner in sent.value:
                of.setdefault(literal, set()).add((number, owner))
            for literal, owners in of.items():
                automaton.add_word(literal, owners)
            automaton.make_automaton()
            for batch in batches:
                at, numbers = [], []
                for i, (text, who) in enumerate(zip(batch.column("text").to_pylist(), batch.column("principal").to_pylist(), strict=True)):
                    hit = {n for _, owners in automaton.iter(text or "") for n, owner in owners if who is None or owner is None or owner != who}
                    at += [i] * len(hit)
                    numbers += sorted(hit, key=str)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(numbers, kind)], names=[id_col, literal_id])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out
