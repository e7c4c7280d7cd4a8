"""Token tables against plain encoding, and what selective reads touch."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tagplane.llm import token_files
from tagplane.llm.token_files import Encoder, TokenFiles


def plain(texts):
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, token_files.END] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def small_files(spark, small_docs, tmp_path_factory):
    return TokenFiles.write(small_docs.repartition(3), str(tmp_path_factory.mktemp("tokens")), row_group=100_000, page=2000, page_rows=10)


def test_rows_equal_plain_encoding(small_files, small_texts):
    ids = sorted(small_texts)
    expected, start = [], 0
    for i, own in zip(ids, plain([small_texts[i] for i in ids]), strict=True):
        expected.append((i, start, len(own), crc(own)))
        start += len(own)
    assert sorted(map(tuple, small_files.checksums().collect())) == expected
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in small_files.lengths().collect()) == [e[:3] for e in expected]


def test_cuts_change_no_id():
    texts = ["a  b", " x", "x ", "a  b", "a  x", "a   x", "\n \n x y", "it's  don't 'll", " <|endoftext|> a<|endoftext|> b", "", "  ", "a \t b", "tab\t x", "　 z", "1 2  3 中文 中", "x\x1c y \x1dz", "é ü „quoted“ word"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, counts = Encoder(token_files.TOKENIZER).texts(data, offsets)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == plain(texts)


def test_layout_and_selective_reads(spark, small_files, small_texts):
    files = sorted(glob.glob(f"{small_files.path}/tokens/*.parquet"))
    groups = [m.row_group(k) for m in (pq.ParquetFile(f).metadata for f in files) for k in range(m.num_row_groups)]
    assert len(groups) > len(files)
    for g in groups:
        columns = {g.column(k).path_in_schema: g.column(k) for k in range(g.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "offset", "n_tokens"))
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    plan = small_files.lengths()._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    one = small_files.documents(7, 9)
    assert "GreaterThanOrEqual(doc_id,7)" in one._jdf.queryExecution().executedPlan().toString()
    ids = sorted(small_texts)
    stream = plain([small_texts[i] for i in ids])
    wanted = [i for i in ids if 7 <= i <= 9]
    assert {r["doc_id"]: list(r["ids"]) for r in one.collect()} == {i: stream[ids.index(i)] for i in wanted}
    whole = [x for own in stream for x in own]
    for a, b in ((0, 1), (0, len(whole)), (1234, 98765), (len(whole) - 3, len(whole) + 5), (5, 5)):
        got = sorted(small_files.stretch(a, b).collect(), key=lambda r: r["at"])
        assert [x for r in got for x in r["ids"]] == whole[a:b]
        assert not got or got[0]["at"] == a


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs, tmp_path):
    got = TokenFiles.write(odd_docs, str(tmp_path / "odd")).checksums().collect()
    rows = odd_docs.select("doc_id", "text").collect()
    expected = sorted(((r["doc_id"] or 0, len(own), crc(own)) for r, own in zip(rows, plain([r["text"] for r in rows]), strict=True)))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = sorted((r["start"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got)
    assert all(a[0] + a[3] == b[0] for a, b in zip(at, at[1:], strict=False))
    assert [a[1:3] for a in at] == sorted(a[1:3] for a in at)
    assert TokenFiles.write(no_docs, str(tmp_path / "none")).checksums().collect() == []
    assert TokenFiles(spark, str(tmp_path / "none")).stretch(0, 9).collect() == []
