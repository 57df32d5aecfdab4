"""Fill-in-middle, the audit of sources and the secret ledger against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from custspark.llm import fim, ledger, skyband

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, row string, spans string, form string, term string"


def _docs(spark, rows):
    """Rows of doc_id, text, lang, source, with extra columns whose names operators use too."""
    return spark.createDataFrame([(*r, 7, "r", "s", "f", "t") for r in rows], SCHEMA)


# ---- fill-in-middle ----

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def _infilled(doc_id, text, cut=50, spm=80, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= cut:
        return len(units), "plain", text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    return (len(units), "spm", s + suf + p + pre + m + mid) if h[3] % 100 < spm else (len(units), "psm", p + pre + s + suf + m + mid)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    pieces = [" ", "\n", "\t\t", "\x0b", "\x1c", " ", " ", "a", "$1", "\\", "<P", "S>", "<", "日本", "😀", "é", "x.y", "{2}", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "one", " one", "one ", "a <M> b", "a<S>", "<P>", "w " * 200_000, "x" * 300_000, " " * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(5, texts[5]), (5, texts[5]), (None, "null id and some words"), (5, "another text with this id")]


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<M>"), ("$1", "\\E", "[m]")])
def test_infilling_equals_brute_force(spark, awkward, marks):
    how = replace(fim.Infilling(), cut_percent=80, prefix=marks[0], suffix=marks[1], middle=marks[2])
    made = fim.transform(_docs(spark, [(i, t, "en", "s") for i, t in awkward]).repartition(4), ["doc_id", "text", "form"], how)
    parted = fim.parts(F.col("output"), F.col("form"), how)
    back = fim.restored(F.col("output"), parted).alias("back")
    rows = made.select("row.*", F.struct("n", "form", "output").alias("made"), parted["middle"].alias("middle"), back).collect()
    want = Counter((i, t, *_infilled(i, t, cut=80, marks=marks)) for i, t in awkward)
    assert Counter((r["doc_id"], r["text"], *r["made"]) for r in rows) == want
    assert all(r["back"] == (r["text"] or "") and r["form"] == "f" for r in rows)
    assert {r["made"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert all((r["middle"] is None) == (r["made"]["form"] == "plain") for r in rows)


def test_long_texts_need_no_stack(spark):
    """All of these are cut, at units far inside the text."""
    docs = _docs(spark, [(i, "word " * 1_000_000, "en", "s") for i in range(3)])
    rows = fim.transform(docs, ["doc_id"], fim.Infilling(cut_percent=100)).select("row.doc_id", "n", "form", "output").collect()
    for r in rows:
        assert (r["n"], r["form"], r["output"]) == _infilled(r["doc_id"], "word " * 1_000_000, cut=100)
    assert fim.transform(docs.limit(0), ["doc_id"]).count() == 0


# ---- audit of sources ----


def _dominated(high, low, names, i):
    return sum(
        high[j] >= high[i] and low[j] <= low[i] and names[j] < names[i] for j in range(len(high)) if j != i
    )


@pytest.mark.parametrize("seed", range(8))
def test_skyband_equals_its_definition(seed):
    rng = np.random.default_rng(seed)
    n, span = int(rng.integers(1, 700)), int(rng.choice([2, 10, 10_000]))
    high, low = rng.integers(1, span + 1, n), rng.integers(1, span + 1, n)
    names = rng.permutation(n)
    for k in (1, 3, 50):
        want = [i for i in range(n) if _dominated(high, low, names, i) < k]
        assert skyband.skyband(high, low, names, k).tolist() == want


def _audited(rows, k, least):
    """The audit in plain Python, from (text, lang, source)."""
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lower)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(w, r[2]) for w, r in zip(words, rows) if r[1] == lang]
        n_docs = Counter(t for w, _ in mine for t in set(w))
        kept = sorted((t for t, n in n_docs.items() if n >= least), key=str.encode)
        count = {s: Counter(t for w, x in mine if x == s for t in w if n_docs[t] >= least) for s in {x for _, x in mine}}
        total = sum(count.values(), Counter())

        def share(c):
            size = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (size + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(total)
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skyband, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(skyband, "BLOCK_TERMS", 20)
    monkeypatch.setattr(skyband, "TERMS_AT_ONCE", 7)
    rng, k = random.Random(2), 9
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Über", "ÜBER", "naïve", "日本", "😀", "WAA", "don't"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, "fr"]), rng.choice([f"s{j}" for j in range(9)] + [None, "big", "big", "big"])
        some = vocabulary[: rng.choice([20, 97])]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randrange(60))), lang, source))
    rows += [(None, "en", "only null"), ("", "en", "s1"), ("12 34 _ !", "en", "no terms"), ("rare words here", "xx", "a"), ("", "xx", "b"), (None, "yy", None)]
    rows += [rows[0]] * 40 + [("long " * 50_000 + "x" * 50_000, "en", "long"), ("", "en", "é"), ("", "en", "z")]
    docs = _docs(spark, [(i, *r) for i, r in enumerate(rows)]).repartition(5)
    got = skyband.audit(docs, k, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got, want = sorted(tuple(r) for r in got.collect()), _audited(rows, k, 5)
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert skyband.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    rows = [(10**13, 10**15, 10**7), (0, 1, 1), (0, 0, 0), (9_223_372_036, 9_223_372_036, 3)]
    df = spark.createDataFrame(rows, "c bigint, t bigint, k bigint")
    got = [r[0] for r in df.select(skyband._share(F.col("c"), F.col("t"), F.col("k"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (t + 5 * k) if k else None for c, t, k in rows]


def test_counts_survive_being_passed_on_early(spark, monkeypatch):
    docs = _docs(spark, [(i, f"a b{i % 7 * 'x'} c" * 3, "en", f"s{i % 3}") for i in range(60)]).coalesce(1)
    want = sorted(map(tuple, skyband.counted(docs, "lang", "source", "text").collect()))
    monkeypatch.setattr(skyband, "COUNTS_AT_ONCE", 4)
    assert sorted(map(tuple, skyband.counted(docs, "lang", "source", "text").collect())) == want


# ---- secret ledger ----


def _secrets(text, rules=ledger.RULES):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, rule.name, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def history():
    rng = random.Random(9)
    pieces = ["password", "Passwd", "SECRET", "token", "api_key", "APIkey", "\u017fecret", "to\u212aen", "=", ": ", "'", '"', " ", "abc123", "short"]
    pieces += ["AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "😀", "\n", "-", "/", "secret:token : abcdefgh"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(300)]
    texts += [None, "", "f" * 200_000, "password=" + "a" * 100_000, "AKIA" * 9, "x" * 100_000]
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(500 + i, texts[i % 20], "en", "copy") for i in range(200)]


def _found(df):
    rows = df.select("row.doc_id", "row.text", "row.spans", F.col("spans").alias("found")).collect()
    assert all(r["spans"] == "s" for r in rows)
    return Counter((r["doc_id"], r["text"], tuple(map(tuple, r["found"]))) for r in rows)


def test_ledger_equals_scanning_and_is_incremental(spark, history, tmp_path, monkeypatch):
    path, keep = str(tmp_path / "ledger"), ["doc_id", "text", "spans"]
    fed = []
    whole = ledger.scanned

    def watched(texts, rules):
        fed.append(sorted((bytes(r["blob"]), tuple(r["missing"])) for r in texts.select("blob", "missing").collect()))
        return whole(texts, rules)

    monkeypatch.setattr(ledger, "scanned", watched)

    def blobs(rows):
        return {hashlib.sha256((r[1] or "").encode()).digest() for r in rows}

    def check(rows, rules=ledger.RULES):
        docs = _docs(spark, rows).repartition(4)
        want = Counter((r[0], r[1], tuple(_secrets(r[1], rules))) for r in rows)
        assert _found(ledger.scan(docs, path, keep, rules)) == want

    first, versions = history[:200], tuple(r.version for r in ledger.RULES)
    check(first)
    assert fed.pop() == sorted((b, versions) for b in blobs(first))
    # Later versions: only blobs not met before are read.
    check(history)
    assert fed.pop() == sorted((b, versions) for b in blobs(history) - blobs(first))
    check(history)
    assert fed.pop() == []
    # A changed rule and a new one: the others are not applied again.
    changed = (replace(ledger.RULES[0], least=8), *ledger.RULES[1:], ledger.Rule("pem", "-----BEGIN [A-Z ]+-----|api"))
    check(history, changed)
    assert fed.pop() == sorted((b, (changed[0].version, changed[3].version)) for b in blobs(history))
    check(history)
    assert fed.pop() == []
    assert len(ledger.recorded(spark, path).select("blob").distinct().collect()) == len(blobs(history))


def test_repeated_and_null_ids_and_an_empty_table(spark, tmp_path):
    text = "token = abcdef123"
    rows = [(1, text, "en", "s")] * 5 + [(None, text, "en", "s"), (None, "secret:zzzzzz", "en", "s"), (1, None, "en", "s")]
    docs, path = _docs(spark, rows), str(tmp_path / "ledger")
    got = _found(ledger.scan(docs, path, ["doc_id", "text", "spans"]))
    assert got == Counter((r[0], r[1], tuple(_secrets(r[1]))) for r in rows)
    assert ledger.recorded(spark, path).count() == 3
    assert ledger.scan(docs.limit(0), str(tmp_path / "none"), ["doc_id"]).count() == 0


def test_letters_beyond_ascii_are_no_keyword():
    assert _secrets("\u017fecret=abcdefgh to\u212aen=abcdefgh") == []
    assert [s[2] for s in _secrets("sEcReT=abcdefgh")] == ["assign"]
