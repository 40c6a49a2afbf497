"""PII, licenses, lines, exact copies: native operators against plain Python."""

import collections
import hashlib
import random
import re
import time
import warnings

import pytest
import regex
from hypothesis import strategies
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, license_rules, license_scan, line_dedup, pii
from lodestone.llm.common import components

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def confirmed(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15, "email": lambda: True}[kind]()


def brute_pii(text):
    spans = sorted((m.start(), i, m.end(), k) for i, k in enumerate(PII) for m in re.finditer(PII[k], text or "") if confirmed(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def hard_texts(seed, alphabet, n=300, longest=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def saved(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_pii_equals_plain_regex(spark, tmp_path):
    texts = hard_texts(1, "a1@..-+ 0.5(9)é😀_%\n4") + hard_texts(2, "12.3 -5+4") + [None, "", "1" * 30_000, "a" * 30_000, "a@b" + ".c" * 20_000, "1.1.1.1 " * 500, "4111 1111 1111 1111 00"]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in pii.op1_pii(spark, saved(spark, tmp_path, rows + [(0, texts[0])])).collect()}
    assert len(out) == len(rows)
    for k, t in rows:
        assert out[k].base_sha256 == hashlib.sha256(brute_pii(t).encode()).hexdigest(), t


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789", "x"), (2, "GB83 WEST 1234 5698 7654 32 and 123-45-6789", "y"), (3, None, None), (4, "mail a@b.cd or 10.0.0.1!", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "iban [IBAN], ssn [NATIONAL_ID]"
    assert got[2].text == rows[1][1] and got[3].text is None and got[4].text == "mail [EMAIL] or [IP]!"
    assert got[4].spans == "z"
    assert pii.detect(df.limit(0)).count() == 0


def brute_license(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def written_rules():
    """The rules read anew from their lines: (priority, label, pattern, second pattern), a blank being any run."""
    out = [(license_rules.TAG, r.label, r.pattern, "") for r in license_rules.rules() if r.priority == license_rules.TAG]
    for lines, priority in ((license_rules.VERSIONS, license_rules.VERSION), (license_rules.NAMES, license_rules.NAME), (license_rules.NOTICES, license_rules.NOTICE)):
        for line in lines.strip("\n").split("\n"):
            label, _, pattern = line.split("|", 2)
            pattern, _, also = pattern.removeprefix(" ").partition(" >> ")
            runs = [regex.sub(r"\[- \]|( \?)| ", lambda m: r"(?:-|[\s*#/]+)" if m[0] == "[- ]" else r"[\s*#/]*" if m[1] else r"[\s*#/]+", x) for x in (pattern, also)]
            out.append((priority, label.strip(), *runs))
    return out


WRITTEN_RULES = written_rules()


def brute_rules(text):
    """Labels of the rules as written by another engine, whose look-behinds have any width, without keywords."""
    low, found = re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), []
    for n, (priority, label, pattern, also) in enumerate(WRITTEN_RULES):
        found += [(m.start(), m.end(), priority, n, label) for m in regex.finditer(pattern, low, regex.ASCII) if regex.search(also, m[0], regex.ASCII)]

    def stronger(e, d):
        return e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[:2] == d[:2] and e[3] < d[3]))))

    return {d[4] for d in found if not any(stronger(e, d) for e in found)}


def test_license_words_and_rules(spark, tmp_path):
    rng = random.Random(3)
    parts = ["gnu", "General", "public", "license", "apache", "CC", "by", "mit", " ", "-", "\n", "é", "SPDX-License-Identifier: MIT", "Apache License, Version 2.0", "GPLv3", "\0", "😀", "GNU Lesser General Public License v2.1", "all rights reserved", "BSD-3-Clause", "Creative Commons Attribution-ShareAlike\n * 4.0", "the zlib/libpng license", "GNU Lesser General Public\n * License, version 2.1"]
    texts = [rng.choice([" ", "-", "  "]).join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    run = lambda: "".join(rng.choice(" \n\t*#/ ") for _ in range(rng.randint(1, rng.choice([2, 12, 200]))))
    wrapped = "GNU General Public License, version 3|GNU Lesser General Public License, version 2.1|Mozilla Public License 2.0|GNU Affero General Public License|Apache License, Version 2.0|all rights reserved|in no event shall the authors or holders of rights named in this long file be liable|in no event. shall be liable|neither the name of a very long list of people and places, and more of them than in eighty letters, may be used to endorse or promote products|copyright (c) 2020|library general public license v2".split("|")
    texts += [re.sub(" ", lambda m: run(), " ".join(rng.choice(wrapped) for _ in range(rng.randint(1, 6)))) for _ in range(200)]
    texts += [None, "", "mit license " * 300, "Licensed under the GNU General Public License, version 3."]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in license_scan.op2_license(spark, saved(spark, tmp_path, rows)).collect()}
    for k, t in rows:
        r, b = out[k], brute_license(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == b, t
        assert r.labels == ",".join(sorted(brute_rules(t) | set(filter(None, b[4].split(","))))), t
        assert 0 <= r.score <= 1


def without_assertions(p):
    while m := re.search(r"\(\?(?:<!|!|<=)", p):
        depth = 0
        for j in range(m.start(), len(p)):
            depth += (p[j] == "(") - (p[j] == ")") if p[j - 1] != "\\" else 0
            if not depth:
                break
        p = p[: m.start()] + p[j + 1 :]
    return p


def test_license_rules_are_gated():
    """No stem, no keyword; no keyword, no match: on strings made from the patterns."""
    rules = license_rules.rules()
    written = [r for r in rules if r.priority != license_rules.TAG]
    assert len({r.pattern for r in written}) >= 300
    assert all(any(s in r.keyword for s in license_scan.STEMS) for r in rules)
    blank = lambda t: re.sub(license_scan.MARKS, " ", t, flags=re.A)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in written:
            made = [re.sub(r"([+*])\+", r"\1", without_assertions(p)).strip("^") for p in (r.pattern, r.also) if p]
            sample = "".join(strategies.from_regex(re.compile(p, re.A), fullmatch=True).example() for p in made if p)
            assert blank(r.keyword) in blank(sample), (r, sample)


def test_spans_grow_in_proportion(spark):
    """Twice the spans, at most about twice the time: nothing is copied once for each span."""
    jobs = {
        "pii": lambda t: pii.redact(pii.detect(t)).select(F.md5("text"), F.size("spans")), "license": lambda t: license_scan.scan(t).select(F.size("detections"), F.size("base")),
    }
    for name, job in jobs.items():
        took = []
        for n in (2_000, 32_000, 64_000):
            text = spark.createDataFrame([(1, "a@b.cd 10.0.0.1 mit license of x " * (n // 4))], "doc_id long, text string")
            began = time.time()
            assert job(text).first()[1] == n // 2 or name == "license"
            took.append(time.time() - began)
        assert took[2] < 3 * took[1] + 2, (name, took)


def test_license_clashes_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, "MIT license", 5, "x")], "doc_id long, text string, score int, base string")
    row = license_scan.scan(odd).first()
    assert row.score == 0.9 and row.score_input == 5 and row.base_input == "x" and [b.label for b in row.base] == ["mit"]
    assert license_scan.scan(odd.limit(0)).count() == 0
    span = pii.detect(spark.createDataFrame([(1, "a@b.cd", "old")], "doc_id long, text string, spans string")).first()
    assert span.spans_input == "old" and [x.kind for x in span.spans] == ["email"]


def test_context_stands_on_both_sides(spark):
    rows = [(1, "123-45-6789 is my ssn"), (2, "ssn 123-45-6789"), (3, "123-45-6789"), (4, "123-45-6789" + "-" * 60 + "ssn")]
    got = {r.doc_id: len(r.spans) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def brute_lines(rows, least=40, docs=5):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    where = collections.defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where[key(x)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where[key(x)]) >= docs and k != max(where[key(x)]))]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark, tmp_path):
    rng = random.Random(4)
    lines = ["x" * 39, "y" * 40, " Y" + "y" * 39 + "\r", "é" * 41, "", "short", "Line number one is common enough to be dropped", "\tLINE number one is common enough to be dropped", "z" * 5000]
    rows = [(i, "\n".join(rng.choice(lines) + (str(rng.randint(0, 3)) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 150 if i % 9 == 0 else 8)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1]), (503, rows[1][1]), (503, rows[2][1] + "\nmore")]
    out = sorted(tuple(r) for r in line_dedup.op8_line_dedup(spark, saved(spark, tmp_path, rows)).collect())
    assert out == brute_lines(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, hash string")
    assert line_dedup.apply_bitmaps(empty, line_dedup.line_bitmaps(empty)).count() == 0


def test_line_plan_streams_and_columns_clash(spark):
    rows = [(i, "a common line that is long enough to count\nown line %d that is long enough to count too" % i, i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = {r.doc_id: r for r in line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect()}
    assert all(out[i].n_lines == 2 and out[i].n_lines_input == i and out[i].n_dropped == (i < 7) for i in range(8))


def test_exact_dedup(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, "b"), (7, "b"), (8, "x" * 100_000), (9, "x" * 100_000)]
    out = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op5_exact_dedup(spark, saved(spark, tmp_path, rows)).collect())
    want = []
    for k, t in rows:
        same = [i for i, u in rows if (u or "") == (t or "")]
        want.append((k, max(same), len(same), k == max(same), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == sorted(want)


def test_digest_index_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_batches", 4)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, digest string")
    first = index.append(make([(1, "a", "q"), (2, "a", "q"), (3, "b", None)]))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in first.collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    second = index.append(make([(9, "a", "q"), (10, "c", "q"), (11, "c", "q")]))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second.collect()) == [(9, 2, False), (10, 11, False), (11, 11, True)]
    assert index.append(make([])).count() == 0
    again = index.append(make([(9, "a", "q"), (10, "c", "q"), (11, "c", "q")]))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.collect()) == [(9, 2, False), (10, 11, False), (11, 11, True)]
    assert index.entries().count() == 3
    join = spark.createDataFrame([(b"a", 1)], "digest binary, n long").hint("merge").join(index.entries(), "digest")
    plan = join._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan and plan.count("Exchange") == 1  # the index is read in its buckets
    index.drop()


@pytest.mark.parametrize("n", [0, 1, 60])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(i, i + 1) for i in range(n)] if n == 60 else []
    edges += [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(n)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(tuple(r) for r in out.select("node", "component").collect()) == sorted((x, find(x)) for x in linked)
    assert out.where(F.col("component") > F.col("node")).count() == 0


WRAPPED = [
    ("gnu lesser general public\n * license, version 2.1", "lgpl-2.1"), ("mozilla public\n# license v2.0", "mpl-2.0"), ("all\n * rights\n * reserved", "all-rights-reserved"), ("redistribution\n// and use in source and binary forms, with or without modification", "bsd"),
    ("beerware license", "beerware"), ("beer-ware license", "beerware"), ("see gnu.org/licenses/old-licenses/gpl", "gpl"), ("creative commons licence", "creative-commons"), ("postgresql licence", "postgresql"),
    ("spdx-license-identifier: " + "(a-long-name or b-long-name) and (" * 3 + " mit", "mit"),
]


def test_license_gate_drops_no_match(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(WRAPPED)], "doc_id long, text string, want string")
    for r in license_scan.scan(df).collect():
        assert r.want in {d.label for d in r.detections}, r.text
    low, every = F.col("text"), F.concat(*[F.lit(x + "\n") for x in sorted({r.keyword for r in license_rules.rules()} | set(license_rules.STEMS))])
    got = df.select("text", license_scan.detections(low, license_scan.gate_text(low)).alias("a"), license_scan.detections(low, license_scan.gate_text(every)).alias("b"))
    assert all(r.a == r.b for r in got.collect())
