import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textward.llm import tokens
from textward.llm.scratch import Scratch

from .cases import SCHEMA, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)


def plain(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, tokens.END]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aB'sé́ \t\n\x1c\x85　Σ<|endoftext|>9漢ﬁ", max_size=60)), max_size=6))
def test_ids_equal_those_of_whole_texts(texts):
    assert ENCODER.by_word
    ids, offs = ENCODER.encode(pa.array(texts, pa.string()), tokens.END)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [plain(t) for t in texts]


def test_forgetting_words_changes_nothing():
    small = tokens.Encoder(PATH, kept=3)
    for k in range(5):
        text = f"alpha{k} beta gamma{k % 2} delta epsilon"
        assert small.encode(pa.array([text]), 1)[0].tolist() == plain(text)


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    assert not encoder.by_word
    texts = ["a  b\n c", None, "", " x"]
    ids, offs = encoder.encode(pa.array(texts), 7)
    whole = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [[*whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_round_trip_and_edge_cases(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = tokens.round_trip(docs, PATH).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in order:
        ids = np.array(plain(r[1]), "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.round_trip(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_files_hold_small_row_groups_with_page_indexes(spark):
    docs = spark.createDataFrame([(i, f"word{i} text " * (i % 50)) for i in range(3000)], "doc_id long, text string")
    path = Scratch(spark, "test").path("ids")
    tokens.write(docs, path, PATH)
    files = [f"{d}" for d in __import__("glob").glob(path.removeprefix("file://") + "/*.parquet")]
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(k).path for k in range(meta.num_columns)]
        ids = meta.row_group(0).column(next(k for k, n in enumerate(names) if n.startswith("ids")))
        assert ids.has_dictionary_page and ids.has_column_index and ids.has_offset_index
    table = tokens.read(spark, path)
    one = table.where("doc_id = 1234").select("n_tokens")
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1234)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert one.first().n_tokens == len(plain(f"word{1234} text " * (1234 % 50)))


def test_a_missing_tokenizer_fails(spark):
    with pytest.raises(Exception):
        tokens.round_trip(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "/no/such/file.json").collect()
