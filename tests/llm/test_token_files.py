import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from weft.llm.common import fresh_folder
from weft.llm.token_files import TokenFile, read_token_digests, write_token_files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_files(spark, name):
    rows = [(9, "last one", 1), (None, "no id", 1), (3, None, 1), (2, "", 1), (5, "twice <|endoftext|>", 1), (5, "twice <|endoftext|>", 1), (7, "word " * 60_000, 1), (8, "<|endoftext|><|endoftext|> x <|endoftext|>y\n<|endoftext", 1), (6, "a   b \n\n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    path = P.path(name)
    folder = fresh_folder(spark, "test-tokens")
    files = write_token_files(df, folder, path, P.PATTERN, end_id=0)
    out = sorted((tuple(r) for r in read_token_digests(spark, folder, files).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(path)
    at = 0
    for (doc_id, text, _), got in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), out, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    f = TokenFile(folder, files[0]["name"], files[0]["kind"])
    assert f[0][-1] == 0 and len(f.offsets) == files[0]["n_docs"] + 1


def test_store_of_a_cluster(monkeypatch):
    from weft.llm import common

    seen = []
    monkeypatch.setattr(common.pyarrow.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(seen.append)}))
    for folder in ("s3a://bucket/x", "hdfs://host/x", "file:/tmp/x", "/tmp/x"):
        common.open_store(folder)
    assert seen == ["s3://bucket/x", "hdfs://host/x", "file:///tmp/x", "file:///tmp/x"]


def test_empty(spark):
    folder = fresh_folder(spark, "test-tokens")
    files = write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert files == [] and read_token_digests(spark, folder, files).count() == 0
