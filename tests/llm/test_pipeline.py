"""Each stage of the corpus pipeline against brute force, on its own input; and the whole run."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from loglattice.llm import common, minhash_dedup, packing
from loglattice.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, by name."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DATA).write.parquet(path)
        made = spark.read.parquet(path)
        out[name] = (docs, made)
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for _name, (before, after) in list(stages.items())[:-1]:
        assert before.columns == after.columns


def test_language_stage(stages):
    before, after = stages["language_id"]
    without_letters = {r.doc_id for r in before.collect() if not re.search(r"[^\W\d_]", r.text or "")}
    assert ids(after) == sorted(set(ids(before)) - without_letters)


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids(after) == sorted(x[1] for x in best.values())


def test_near_stage(stages):
    before, after = stages["minhash_dedup"]
    rows = before.collect()
    shingles = [minhash_dedup.shingles_of(minhash_dedup.hashes_of(r.text or "")) for r in rows]
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(rows, shingles, strict=True), 2):
        if minhash_dedup.similarity(x, y) >= 0.8:
            p, q = root(a.doc_id), root(b.doc_id)
            parent[max(p, q)] = min(p, q)
    assert ids(after) == sorted({root(r.doc_id) for r in rows})


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.split())
    for r in after.collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert set(copies) <= set(ids(before)) and max(copies.values()) <= 2
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.03)


def test_packing_stage(stages):
    before, after = stages["packing"]
    whole = Tokenizer.from_file(llm.public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before.collect():
        n = len(whole.encode(r.text, add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, min(2048, n - i)) for k, i in enumerate(range(0, n, 2048)))
    got = after.collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == want
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    assert len(fills) <= 1.01 * packing.lower_bound(np.array([r.length for r in got])) + 1


def test_whole_run(spark, stages):
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in __spark_entry__.queries()["pipeline"](spark, DATA).collect())
    assert got == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages["packing"][1].collect())


def test_every_operator_has_one_query():
    names = [n for n in llm.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_rows_reach_python_in_small_batches(spark, monkeypatch):
    """Each stage is written with bounded batches, as executors' memory holds the workers' batches, too."""

    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1).append_column("n", pa.array([b.num_rows])) for b in batches), "doc_id long, n long")

    monkeypatch.setattr(common, "BATCH", 20_000)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes), ("last", lambda spark, docs, sf_dir: common.written(docs))])
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert len(rows) > 1 and max(r.n for r in rows) < sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_tables_for_words_stay_small():
    """What a worker holds of powers, for hashes of words, while it tokenises 3 million characters."""
    import public_tokenizers

    packing._POWERS.clear()
    text = "some words here " * 190_000
    ids = b"".join(packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))([text]))
    assert len(ids) == 4 * 3 * 190_000 and sum(x.nbytes for x in packing._POWERS) < 20_000_000
