"""Operators 11 to 13 against brute force, their odd rows, and the queries on the smallest tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvefront.llm import fill_middle, periodic_runs, pii, queries
from solvefront.llm.common import stage

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "base string, spans string, runs string, n_words string, collapsed string, n string, form string, output string, _in_0 string, _key string"
ODD = [
    None, "", " \n\t ", "\n\n", "a\nb", "a\nb\n", "\x1e\x1b\x1bd\n\x1ee\x1b", "x <P> y", "<S><M>", "a@b.c x" * 3, "äöü 漢字\n😀 no end", "w " * 20_000, "no-space" * 30_000, "1" * 100_000,
    "+1" * 50_000, "tie tie tie tie tie tie", "a b a b a b a b c", "x" * 50 + "\n" + "y\n" * 3000,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark):
    rows = [(i, t, *[f"{c}{i}" for c in range(10)]) for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "null key\nof two lines", *["-"] * 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASHES), rows


# --- fill in the middle -------------------------------------------------------------------------------------------


def middle(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = sha(f"7:{'null' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not t or re.search("<[PSM]>", t):
        return n, "plain", None, None, t
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_on_odd_rows(spark):
    df, rows = odd_rows(spark)
    made = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert set(made.columns) >= {"base", "_in_0", "_key", "runs"}
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back, r["_in_0"]) for r in made.collect()), key=repr)
    want = sorted(((r[0] if r[0] is not None else -1, *middle(r[0], r[1]), r[1] or "", r[10]) for r in rows), key=repr)
    assert got == want
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0


def test_fill_in_middle_rates_and_other_units(spark):
    df = spark.createDataFrame([(i, f"one two {i}\nthree") for i in range(300)], "k long, body string")
    made = fill_middle.fill_in_middle(df, "body", "k", unit=r"[^ ]* |[^ ]+", rate=40, spm_rate=100, markers=("[pre]", "[suf]", "[mid]")).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    forms = [r.form for r in made]
    assert "psm" not in forms and 80 < forms.count("spm") < 160 and all(r.back == r.body and r.n == 3 for r in made)


def test_fill_in_middle_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.QUERIES["op13_escaped_markers"](spark, tiny).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, p, m, out = middle(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(docs[r.doc_id] or ""))


# --- periodic runs ------------------------------------------------------------------------------------------------


def brute_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and all(any(w[x] != w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = np.random.default_rng(3)
    for _ in range(150):
        docs = []
        for letters in rng.integers(1, 5, rng.integers(1, 6)):
            w = rng.integers(0, letters, rng.integers(0, 90))
            n = len(w)
            if n > 10 and rng.random() < 0.6:
                a, p, i = rng.integers(0, n), rng.integers(1, n // 3), np.arange(n)
                w = np.where(i >= a, w[np.minimum(a + (i - a) % p, n - 1)], w)
            docs.append(w)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        for least, exponent in ((6, 4), (4, 4), (10, 5)):
            got = periodic_runs.runs_of(np.concatenate(docs).astype(np.int64), bounds, least, exponent)
            assert [tuple(r) for r in got.tolist()] == [(s + b, s + n + b, q) for d, b in zip(docs, bounds.tolist()) for s, n, q in brute_runs(d.tolist(), least, exponent)]


def test_runs_of_special_words():
    one = lambda w: periodic_runs.runs_of(np.asarray(w), np.array([0, len(w)])).tolist()
    assert one(np.zeros(200_000, np.int64)) == [[0, 200_000, 1]]
    assert one(np.arange(100_000) % 999) == [[0, 100_000, 999]]
    assert one(np.array([bin(i).count("1") % 2 for i in range(1 << 15)])) == []  # no cube at all
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, np.int64), np.array([0, 9]), 6, 2)
    assert periodic_runs.overlap() == 5 and periodic_runs.overlap(1, 4) == 3


def test_a_wrong_fingerprint_is_found(monkeypatch):
    """A base under which everything is equal: its runs fail the comparison word by word, and the next base is taken."""
    rng = np.random.default_rng(5)
    w = rng.integers(0, 2, 300)
    right, tried = periodic_runs.runs_of(w, np.array([0, 300])).tolist(), []
    equal = periodic_runs.Fingerprints.equal
    made = periodic_runs.Fingerprints.__init__
    monkeypatch.setattr(periodic_runs.Fingerprints, "__init__", lambda self, words, base: (tried.append(base), made(self, words, base))[1])
    monkeypatch.setattr(periodic_runs.Fingerprints, "equal", lambda self, at, shift, n: np.ones(len(at), bool) if len(tried) == 1 else equal(self, at, shift, n))
    assert periodic_runs.runs_of(w, np.array([0, 300])).tolist() == right and len(tried) == 2


def test_periodic_runs_on_odd_rows(spark):
    df, rows = odd_rows(spark)
    made = periodic_runs.periodic_runs(df)
    assert set(made.columns) == set(df.columns)
    got = sorted(((r["_in_0"], r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in made.collect()), key=repr)
    want = []
    for r in rows:
        w = WORDS.findall(r[1] or "")
        found = [(0, 20_000, 1)] if len(w) == 20_000 else [(1, 3000, 1)] if len(w) == 3001 else brute_runs(w)
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        want.append((r[10], len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0


def test_periodic_runs_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.QUERIES["op12_main_lorentz"](spark, tiny).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        w = WORDS.findall(docs[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = brute_runs(w)
        gone = {x for s, k, q in found for x in range(s + q, s + k)}
        best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in found))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


# --- personal data ------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def named(spans):
    return [(pii.KINDS[k], s, e) for k, s, e in spans]


def test_base_spans_of_random_text():
    rng = random.Random(4)
    bits = ["a", "Z", "9", "4111", "1111", "@", ".", "-", "_", "%", "+", " ", "(", ")", "0", "255", "256", "é", "漢", "\n", "x@y.z", "4111111111111111", "+1 (555) 555-0199", "1.2.3.4", ",", "00"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert named(pii.base_spans(text)) == brute_spans(text), text


def test_base_spans_of_long_runs():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 150_000, "+1" * 150_000, "1." * 150_000, "a.b@" + "c." * 150_000, "+1" + "(" * 300_000):
        assert all(e <= len(text) for _, _, e in pii.base_spans(text))


def planted():
    """Identifiers behind words that seeds share, and behind words that ordinary ones share; each text has its own words around."""
    docs, hidden = [], {}
    fill = lambda i: f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x"
    for i in range(40):
        docs.append((i, f"{fill(i)} kontakt adresse user{i}@mail{i}.example.com {fill(i + 7)}"))
    for i in range(40, 46):
        text = f"{fill(i)} {fill(i + 3)} kontakt adresse näme{i}(at)host é {fill(i + 5)}"
        hidden[i] = ("email", text.index("n\u00e4me"), text.index("(at)"))
        docs.append((i, text))
    for i in range(46, 60):
        text = f"été Kontakt adresse id-{i}x45, {fill(i)}"
        hidden[i] = ("email", text.index("id-"), text.index(","))
        docs.append((i, text))
    for i in range(60, 160):  # the same two words before all kinds of things
        docs.append((i, f"{fill(i)} about the {'10.0.0.%d' % i if i % 10 == 0 else fill(i * 3)} {fill(i + 1)}"))
    docs.append((160, "nothing about the year1999 here"))
    for i in range(161, 170):  # what is discovered supports a pattern of its own, which discovers the last one
        docs.append((i, f"so ticket owner id-{i - 115}x45 {fill(i)}"))
        hidden[i] = ("email", 16, 16 + len(f"id-{i - 115}x45"))
    docs.append((170, "so ticket owner zz-9999 qqq"))
    hidden[170] = ("email", 16, 23)
    return docs, hidden


def test_contexts_discover_identifiers(spark):
    docs, hidden = planted()
    df = spark.createDataFrame(docs + [docs[50]] * 3, "doc_id long, text string")
    rows = pii.extract(spark, df).collect()
    assert len(rows) == len(docs) + 3
    for r in rows:
        base = brute_spans(dict(docs)[r.doc_id])
        assert named(r.base) == base
        assert [x for x in named(r.spans) if x not in base] == ([hidden[r.doc_id]] if r.doc_id in hidden else []), dict(docs)[r.doc_id]
    none = pii.extract(spark, df, rounds=1).where("doc_id = 170").first()
    assert none.spans == []  # it takes the second round


@pytest.mark.parametrize("first", [4096, 8])
def test_confidence_against_brute_force(spark, monkeypatch, first):
    """Support and fillers of each confident pattern, counted in plain Python, over all texts at once and in growing parts."""
    monkeypatch.setattr(pii, "FIRST_PART", first)
    docs, _ = planted()
    df = stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "docs")
    slots = pii.seeds_and_slots(df, "text").select(F.explode("slots").alias("s")).select("s.*")
    got = {r.shown: r for r in pii.learn_patterns(spark, df, "text", slots, rounds=1).collect()}
    r = got["kontakt adresse _"]
    cut = [re.findall(r"[a-z0-9\x80-\U0010ffff]+(?:[._%+@-][a-z0-9\x80-\U0010ffff]+)*|[^\sa-z0-9\x80-\U0010ffff]+", t.lower()) for _, t in docs]
    fillers = {w[i + 2] for w in cut for i in range(len(w) - 2) if w[i : i + 2] == ["kontakt", "adresse"]}
    assert r.support == 40 and r.fillers == len(fillers) and r.confidence == pytest.approx(40 / (len(fillers) + 1))
    assert not any("about the" in s for s in got)


def test_extract_on_odd_rows(spark):
    df, rows = odd_rows(spark)
    made = pii.extract(spark, df)
    assert set(made.columns) == set(df.columns) - {"text"}
    got = sorted(((r["_in_0"], named(r.base)) for r in made.collect()), key=repr)
    assert got == sorted(((r[10], brute_spans(r[1] or "") if len(r[1] or "") < 50_000 else []) for r in rows), key=repr)
    assert pii.extract(spark, df.where("false")).count() == 0


def test_extract_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.QUERIES["op11_bootstrapped_contexts"](spark, tiny).collect()
    assert len(got) == len(docs)
    seen = 0
    for r in got:
        base = brute_spans(docs[r.doc_id] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in pii.KINDS)
        assert r.base_sha256 == sha(listed) and set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        seen += bool(base)
    assert seen
