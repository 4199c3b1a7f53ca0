"""Each stage of the pipeline against brute force on the smallest tables."""

import hashlib
import os
import re
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from twintable.llm import byte_bpe, decontaminate, toxicity  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(docs):
    """The smallest id of each class of near copies."""
    sets = {d: shingles(t) for d, t in docs.items()}
    first, left = {}, sorted(sets)
    for d in left:
        if d in first:
            continue
        first[d], open_ = d, [d]
        while open_:
            x = open_.pop()
            for y in left:
                if y not in first and sets[x] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                    first[y] = d
                    open_.append(y)
    return set(first.values())


def test_stages(spark, tmp_path):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "byte_bpe"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, tables = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        assert i == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append(docs)
    text = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in [spark.read.parquet(f"{SF_DIR}/documents.parquet"), *tables[:4]]]

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = toxicity.toxicity(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
    assert set(text[1]) == {r.doc_id for r in judged.where("predicted = 0").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()} & set(text[0])
    assert len(clean - set(text[1])) <= 0.02 * len(clean)

    assert set(text[2]) == near(text[1]) and len(text[2]) < len(text[1])

    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    holds = {d for d, t in text[2].items() if any(decontaminate.myers(x, n)[0] <= int(0.05 * len(x)) for n in [decontaminate.normalise(t)] for x in items if x[:8] in n or x[-8:] in n)}
    assert holds and set(text[3]) == set(text[2]) - holds

    assert set(text[4]) == set(text[3])
    changed = {d for d in text[4] if text[4][d] != text[3][d]}
    assert all(set(re.split(r"\[SECRET\]", text[4][d])) and text[4][d].count("[SECRET]") for d in changed)
    for d in changed:  # what stays is a subsequence in order
        at = 0
        for part in text[4][d].split("[SECRET]"):
            at = text[3][d].index(part, at) + len(part)
    assert {r.doc_id: r.n_chars for r in tables[3].collect()} == {d: len(t) for d, t in text[4].items()}

    with open(byte_bpe.public_ranks(), "rb") as f:
        import base64

        coder = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = {}
    for d, t in text[4].items():
        ids = coder.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in tables[4].collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == set(want)


def test_empty_and_null_documents_pass(spark, tmp_path):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, None, "s", None)]):
        docs = spark.createDataFrame(rows, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{len(rows)}-{i}"
            stage(spark, docs, SF_DIR).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= len(rows) and (docs.where(F.col("n_tokens") > 0).count() == 0)
