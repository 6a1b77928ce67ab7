"""The pipeline's stages on a small corpus, against what each is defined to keep."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from manifolder.llm import entries
from tests.llm.test_text_operators import brute_fingerprint, brute_targets, classes

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    kept = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return [df.collect() for df in kept]


def test_stage_order_and_columns(spark, stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "mixing sources", "best-fit packing"]
    assert all(rows[0].__fields__ == COLUMNS for rows in stages[:-1])


def test_toxicity_drops_what_it_rejects(spark, stages):
    toxic = {r.doc_id for r in entries.op5_toxicity(spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0]} - toxic and toxic


def test_dedup_keeps_one_of_each_group(stages):
    before = sorted(stages[1], key=lambda r: r.doc_id)
    parent = classes([brute_fingerprint(r.text) for r in before], lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for r, p in zip(before, parent):
        least.setdefault(p, r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(least.values())


def test_mix_meets_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in stages[2]:
        sizes[r.source] += size(r.text)
    for r in stages[3]:
        taken[r.source] += size(r.text)
    target = brute_targets(dict(sizes))
    largest = {s: max(size(r.text) for r in stages[2] if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert max(Counter(r.doc_id for r in stages[3]).values()) <= 3


def test_packing_places_every_token(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in stages[3]:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4]) == want
    bins = defaultdict(int)
    for r in stages[4]:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= sum(bins.values()) / 2048 * 1.02 + 1


def test_run_is_all_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces = lambda rows: Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows)
    assert pieces(rows) == pieces(stages[4])


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
