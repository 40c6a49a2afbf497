"""Near copies of the pipeline against brute force."""

import random

import corpus_pipeline
from lodestone.llm import near_copies as nc
from lodestone.llm import simhash

from .test_model_ops import roots


def planted(n, seed=8):
    """Texts of 8 to 400 words, each with copies that have a few words edited."""
    rng, out = random.Random(seed), [None, "", "one two", "One  two"]
    for _ in range(n):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 20, 40, 90, 400]))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(copy))
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_stage_equals_brute_force(spark, monkeypatch):
    texts = planted(120)
    sets, fp = [shingles(t) for t in texts], [simhash.fingerprint(t or "", 5) for t in texts]
    close = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = roots(len(texts), close + [(a, b) for b in range(len(texts)) for a in range(b) if (fp[a] ^ fp[b]).bit_count() <= 3])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, r in enumerate(root) if i == r}
    assert sum((fp[a] ^ fp[b]).bit_count() > 3 for a, b in close) > 50
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()} == want
    monkeypatch.setattr(nc, "PAIRS_PER_MEMBER", 0)  # by pivots as long as they help
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()} == want


def test_sketches_keep_similar_pairs():
    """At similarity 0.8 sketches agree in LIKELY places; texts that share little do not."""
    rng = random.Random(9)
    for _ in range(200):
        both = [rng.getrandbits(64) for _ in range(800)]
        a, b = (nc.np.array(sorted({*both, *(rng.getrandbits(64) for _ in range(100))}), nc.np.uint64) for _ in range(2))
        assert nc.similar(a, b) and nc.alike(nc.sketch(nc.minima(a)), nc.sketch(nc.minima(b)))
        other = nc.np.array([rng.getrandbits(64) for _ in range(900)], nc.np.uint64)
        assert not nc.alike(nc.sketch(nc.minima(a)), nc.sketch(nc.minima(other)))
