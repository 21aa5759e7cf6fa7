"""The registered queries against their SQL, and the pipeline stage by stage."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from compare import connect, same
from test_operators import brute_lines, brute_print, lines_left, shingle_components, union, words
from tokenizers import Tokenizer

import corpus_pipeline
from terradelta.llm import mixing, simhash, toxicity
from terradelta.llm.common import stage_table, table
from terradelta.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert same(spark, connect(SF), QUERIES[name], ORACLES[name], SF)


def test_every_query_and_stage_is_there():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]


def test_pipeline_stages(spark):
    docs = start = table(spark, SF, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage_table(stage(spark, docs, SF), "test")
        if name != "packing":
            assert out.columns == start.columns
        counts.append(out.count())
        docs = out
    toxic, lines, near, mixed, pieces = counts
    assert 0 < toxic <= start.count() and lines == toxic and near <= lines and mixed > 0 and pieces > 0
    assert corpus_pipeline.run(spark, SF).count() == pieces


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.orderBy("doc_id").collect()
    stages = dict(corpus_pipeline.STAGES)
    read = lambda name, df: stage_table(stages[name](spark, df, SF), "test")

    g = toxicity.fit(docs, table(spark, SF, "labels"))
    clean = [r for r in rows if g.chance(toxicity.sums_of(r.text or "", g.compiled())[0]) < 0.3]
    out = read("toxicity", docs)
    assert sorted(r.doc_id for r in out.collect()) == [r.doc_id for r in clean]

    left = {r.doc_id: lines_left(r.text, gone) for r, gone in zip(clean, brute_lines([r.text for r in clean]), strict=True)}
    out = read("line dedup", out)
    assert {r.doc_id: r.text for r in out.collect()} == left

    ids = sorted(left)
    groups = shingle_components([left[i] or "" for i in ids])
    kept = {min(ids[n] for n in group) for group in groups}
    out = read("near dedup", out)
    assert {r.doc_id for r in out.collect()} == kept and out.count() == len(kept)

    copies = {r.doc_id: r.copies for r in mixing.mix(out).collect()}
    sources, total = defaultdict(int), 0
    out = read("mixing", out)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == +Counter(copies)
    for r in got:
        sources[r.source] += len(words(r.text))
        total += len(words(r.text))
    assert sources and total

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, out, SF).collect()
    tokens = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in got)
    held = defaultdict(int)
    for p in pieces:
        held[p.sequence_id] += p.length
    assert sum(p.length for p in pieces) == tokens and max(held.values()) <= 1024


def test_pipeline_near_dedup_links_fingerprints(spark):
    """One document of each component of op7 stays, though shingle sets be far apart; and of what is similar beyond that."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    texts = ["", None, " \n", "one"]
    for _ in range(3):  # a phrase fills the fingerprint, but is a tenth of the distinct shingles
        phrase = some(7) * 10
        texts += [" ".join(phrase + some(30)) for _ in range(14)]
    base = some(300)
    texts += [" ".join(base), " ".join([*base[:100], *some(3), *base[103:]]), " ".join(some(80))]
    rng.shuffle(texts)

    ids, prints = range(len(texts)), [brute_print(t) for t in texts]
    near = [(a, b) for a in ids for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    alike = [(g[0], n) for g in shingle_components([t or "" for t in texts]) for n in g[1:]]
    assert {(prints[a] ^ prints[b]).bit_count() for a, b in near} == {0, 1, 2}
    root, shingles = union(near + alike, ids), union(alike, ids)
    least = lambda root: {min(n for n in ids if root(n) == r) for r in {root(n) for n in ids}}
    assert len(least(root)) < len(least(shingles)) and len(least(root)) < len(least(union(near, ids)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(least(root))
    kept = Counter(r.component_id for r in simhash.near_groups(docs).collect() if r.doc_id in least(root))
    assert max(kept.values()) == 1
