"""Source divergence, licence notices and filter interactions against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_similar import LOWER
from tierflow.llm import divergence, filter_audit, licenses

DOCS = "doc_id bigint, text string, lang string, source string, term string, part string, mask int, words string, n bigint"


def frame(spark, rows, parts=3):
    """Rows (id, text, lang, source) with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "x", 7, "x", 9) for r in rows], DOCS).repartition(parts)


# ---- filter interactions

TEXTS = [
    "", " \t\n", None, "AB", "word", "a b " * 60, " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}" for i in range(120)),
    " ".join(f"w{i % 90}" for i in range(120)), "x | y", " ".join(f"w{i}" for i in range(120)) + "\x0b#", "\xa0" * 10, "é" * 19 + "AA",
    "\x00 a", " ".join(f"Wé{i}" for i in range(99)),
]


def audit_rows(seed=3, n=300):
    draw = random.Random(seed)
    rows = [(i, draw.choice(TEXTS), draw.choice(["en", "de", None, ""]), "s") for i in range(n)]
    # One text is in a third of the rows, one row is there three times, two texts have one id, one has none.
    rows += [(1000 + i, TEXTS[6], "en", "s") for i in range(150)] + [(2000, TEXTS[9], "de", "s")] * 3
    return [*rows, (3, "a different text", "en", "s"), (None, TEXTS[6], "en", "s"), (None, "by itself", "fr", "s")]


def brute_failures(rows):
    smallest = {}
    key = lambda i: (i is None, i or 0)
    for i, t, *_ in rows:
        smallest[t or ""] = min(smallest.get(t or "", (True, 1)), key(i))
    for i, t, lang, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield i, lang or "", {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": key(i) > smallest[t],
        }


def brute_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    by_part = defaultdict(list)
    for i, part, fails in brute_failures(rows):
        by_part[part].append((fails, i in good and i is not None, i in toxic and i is not None))
    for part, docs in by_part.items():
        removals = defaultdict(int)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removals[f] += len(gone)
                unique = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                found.append([part, "".join(order), step, len(left), len(gone), sum(d[0][f] for d in docs) - len(gone), unique, sum(d[1] for d in gone), sum(d[2] for d in gone)])
        yield from ((*row, removals[row[1][row[2] - 1]]) for row in found)


def test_filter_audit(spark):
    rows = audit_rows()
    draw = random.Random(4)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(200)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, mask int")
    found = filter_audit.audit(frame(spark, rows), marks)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_audit(rows, labels))


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), none).count() == 0
    # Without labels, and all of one part: 120 orders of five steps, nothing good lost.
    found = filter_audit.audit(frame(spark, [(1, "x" * 3_000_000, "en", "s")]), none).collect()
    assert len(found) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in found)
    assert {r["kept"] for r in found if r["step"] == 5} == {0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=32))
def test_gray_code_visits_every_subset(cells):
    states = filter_audit.survivors(list(cells), list(cells.values()) or [(0, 0)] * 0)
    assert len(states) == 32
    for subset, sums in states.items():
        for k, total in enumerate(sums):
            assert total == sum(v[k] for mask, v in cells.items() if not mask & subset)


# ---- source divergence


def brute_divergence(rows, min_df, top=50):
    by_group, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(divergence.TERM, (text or "").translate(LOWER))
        by_group[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        share = lambda counts, total: {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}
        sources = sorted(s for a, s in by_group if a == lang)
        p = {s: share(by_group[lang, s], sum(by_group[lang, s][t] for t in kept)) for s in sources}
        whole = sum((by_group[lang, s] for s in sources), Counter())
        q = share(whole, sum(whole[t] for t in kept))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if by_group[lang, s][t] and p[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                yield from ((lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(listed, 1))


def divergence_rows(seed=5, n=240):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeé", k=draw.randint(1, 4))) for _ in range(80)] + ["Straße", "ÉTÉ", "日本", "\U0001f600x"]
    rows = []
    for i in range(n):
        source = draw.choice(["a", "a", "a", "b", "c", "d", None, "é", "Z"])
        words = draw.choices(vocabulary, k=draw.randint(0, 30)) + [f"only{source}"] * draw.randint(0, 3)
        rows.append((i, draw.choice([" ", "-", "1"]).join(w.upper() if draw.random() < 0.2 else w for w in words), draw.choice(["en", "de", None, ""]), source))
    rows += [(500, None, "en", "silent"), (501, "12 34", "en", "digits"), (502, "once", "fr", "x"), (503, "", "fr", "y"), (504, "alone", "it", "x")]
    return rows + [(600, "copy of one row", "en", "a")] * 40 + [(None, "tie tie", "en", "b")]


@pytest.mark.parametrize("block, rows_a_task, chunk, held", [(256, 50_000, 4096, 500_000), (2, 40, 5, 20)])
def test_divergence(spark, monkeypatch, block, rows_a_task, chunk, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TASK_ROWS", rows_a_task)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = divergence_rows()
    found = divergence.audit(frame(spark, rows), min_df=3, top=7)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_divergence(rows, 3, 7))


def test_divergence_of_little(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    # No term is in 30 documents: every distance is zero, and ranks go by name.
    rows = [(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "x " * 400_000, "en", "u")]
    found = sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect())
    assert found == [("en", a, "pair", b, 0, k) for a, b, k in ("st1", "su2", "ts1", "tu2", "us1", "ut2") for k in [int(k)]]


def test_shares_of_large_counts(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 7), (0, 3, 9)], "n bigint, total bigint, v bigint")
    found = [r[0] for r in rows.select(divergence.share("n", "total", "v")).collect()]
    assert found == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in ((9 * 10**18, 91 * 10**17, 7), (0, 3, 9))]


def test_sums_are_those_of_count_vectors(spark):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    rows = [r for r in divergence_rows() if r[2] == "de"]
    docs = frame(spark, rows)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = docs.select("source", F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(divergence.TERM), F.lit(0)).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=4.0, vocabSize=2**31 - 1).fit(listed)
    wanted = Counter()
    for r in model.transform(listed).collect():
        for k, n in zip(r["v"].indices, r["v"].values):
            wanted[r["source"] or "", model.vocabulary[k]] += int(n)
    sums = divergence.group_sums(docs).where("term IS NOT NULL")
    kept = {r["term"] for r in sums.groupBy("term").agg(F.sum("df").alias("df")).where("df >= 4").collect()}
    assert kept == set(model.vocabulary)
    assert {(r["source"], r["term"]): r["n"] for r in sums.collect() if r["term"] in kept} == dict(wanted)


# ---- licence notices


def test_words_are_found_by_a_table_of_characters(spark):
    text = "".join(f"{chr(c)}{chr(c)} a" for c in range(0x3000)) + "\U00020000b\U0010ffff"
    assert re.findall(licenses.LISTED, text) == re.findall(licenses.WORD, text)
    docs = spark.createDataFrame([(text,)], "text string")
    found = docs.select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (licenses.LISTED, licenses.WORD))).first()
    assert found[0] == found[1] == re.findall(licenses.WORD, text)
    plan = docs.select(licenses._words("text"))._jdf.queryExecution().analyzed().toString()
    assert "\\x00\\x01" in plan and "\\x00-" not in plan


MIT, APACHE = licenses.NOTICES[0][1], licenses.NOTICES[4][1]
NOTICES = [
    ("Released under the MIT License.", "mit", "mit", 1.0),
    ("Licensed under the Apache License, Version 2.0.\nunder the\tmit   license", "apache-2,mit", "apache-2,mit", 1.0),
    ("CC-BY-NC 4.0 cc by nc", "cc-by-nc", "cc-by-nc", 1.0),
    ("under the mit licenses", "", "", 0.0),
    ("under the MIT license of nobody under the mit license\u00e9", "mit", "mit", 1.0),
    ("# " + MIT.replace(" ", "\n# ").upper(), "", "mit", 1.0),
    ("x " * 30 + MIT.replace("obtaining a copy", "getting a copy"), "", "mit", 19 / 20),
    (MIT.replace("free of charge", "free of any charge"), "", "", 0.0),
    (MIT.split(" files")[0], "", "", 0.0),
    ("* You may not use this file except in compliance\n * with the License. You may obtain a copy of the License at", "", "apache-2", 1.0),
    ("This program is free software under the terms of the GNU Affero General Public License", "", "agpl", 1.0),
    ("work is licensed under the GNU General Public License, version 3.", "", "gpl", 1.0),
    ("mit " * 5000 + "under the mit license " * 3 + "license " * 5000, "mit", "mit", 1.0),
    ("y " * 300_000 + APACHE, "", "apache-2", 1.0),
    ("", "", "", 0.0), (None, "", "", 0.0), ("...", "", "", 0.0), ("日本 license", "", "", 0.0),
]


def notice_words(text):
    return re.findall(licenses.WORD, (text or "").translate(LOWER))


def brute_places(words):
    for t in licenses.TEMPLATES:
        for s in range(len(words)):
            if all(tuple(words[s + p : s + p + len(k)]) == k for p, k in t.keys):
                share = sum(a == b for a, b in zip(words[s:], t.words)) / len(t.words)
                if share >= licenses.LEAST:
                    yield t.label, t.is_phrase, s, share


def test_notices(spark):
    rows = [(i, x[0], "en", "s") for i, x in enumerate(NOTICES)] + [(0, NOTICES[0][0], "en", "s"), (None, NOTICES[1][0], "en", "s")]
    docs = frame(spark, rows)
    found = licenses.summary(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        text, base_labels, labels, score = NOTICES[1 if r["doc_id"] is None else r["doc_id"]]
        words = notice_words(text)
        places = [s for *_, is_phrase, s, _ in brute_places(words) if is_phrase]
        assert (r["base_labels"], r["labels"], r["n_words"]) == (base_labels, labels, len(words)), text[:80]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert r["score"] == pytest.approx(score)
    assert licenses.summary(frame(spark, [])).count() == 0


def test_places_by_brute_force(spark):
    draw = random.Random(6)
    pieces = [t.words for t in licenses.TEMPLATES] + [k for t in licenses.TEMPLATES for _, k in t.keys]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randint(0, 6)):
            piece = list(draw.choice(pieces))
            if draw.random() < 0.4:
                piece[draw.randrange(len(piece))] = draw.choice(["other", *draw.choice(pieces)])
            words += piece if draw.random() < 0.7 else piece[: draw.randint(0, len(piece))]
        rows.append((i, " ".join(words), "en", "s"))
    docs = frame(spark, rows)
    for rare in (1, 2, 4):
        found = {r["doc_id"]: r["places"] for r in licenses.find_notices(docs, rare=rare).collect()}
        assert sum(map(len, found.values())) > 100
        for i, text, *_ in rows:
            assert sorted(tuple(p) for p in found[i]) == sorted(brute_places(notice_words(text)))


def test_index_posts_the_rarest_words(spark):
    rows = [(i, "under the license", "en", "s") for i in range(9)] + [(10, "mit mit the", "en", "s"), (11, "the", "en", "s")]
    counts = licenses.document_frequencies(frame(spark, rows))
    assert (counts["the"], counts["under"], counts["mit"], counts["gnu"]) == (11, 9, 1, 0)
    assert licenses.rare_words(licenses.TEMPLATES[0], counts) == [("mit", 2), ("license", 3)]


def test_a_kelvin_sign_is_no_k(spark):
    rows = [(1, "o\u212a now OK NOW", "en", "s"), (2, "\u0130t is \u00c9", "en", "s")]
    found = licenses.find_notices(frame(spark, rows), templates=(licenses.Template.of("x", "ok now"),)).collect()
    assert sorted((r["doc_id"], r["n_words"], [p["word"] for p in r["places"]]) for r in found) == [(1, 4, [2]), (2, 3, [])]


def test_the_main_path_is_native(spark):
    plan = licenses.summary(spark.createDataFrame([(1, "a")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))
