import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequarry.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(three)
    hit = {k + d for k, t in enumerate(three) if n[t] > 1 for d in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(hit), "n_lines": lines, "n_capitals": len(re.findall("[A-Z]", text)), "n_bangs": text.count("!")}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#!Zé　", max_size=60)), max_size=6))
def test_measures_against_plain_counting(texts):
    got = quality.measure(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert {m: int(got[m][k]) for m in quality.MEASURES} == brute(t)


def test_measured_keeps_columns(docs, nothing):
    got = quality.measured(docs.withColumn("n_words", docs["size"]))
    assert all(r["n_words"] == brute(r["text"])["n_words"] and r["size"] == "clash" for r in got.collect())
    assert quality.measured(nothing).count() == 0


def test_exact_binomial_tail():
    assert abs(quality.tail(0, 100, 0.02) - 0.98**100) < 1e-12
    assert abs(quality.tail(2, 5, 0.5) - 0.5) < 1e-12 and quality.tail(3, 0, 0.1) == 1.0


def test_certified_sequence_stops_at_the_first_failure():
    assert quality.certified([0, 0, 0, 5000], 0.01, 0.05) == 3
    assert quality.certified([0, 100, 0, 1000], 0.01, 0.05) == 1
    assert quality.certified([0, 0, 50], 0.01, 0.05) == 0  # too few to show anything


def labelled(spark, good, bad, lang="en"):
    cols = ", ".join(f"{m} long" for m in quality.MEASURES)
    fine = [(lang, 1, 100, 500, 0, 0, 0, 10, 2, 0)] * good
    junk = [(lang, 0, 100, 500, 90, 0, 0, 10, 2, 0)] * bad
    return spark.createDataFrame(fine + junk, f"lang string, quality int, {cols}")


def test_cutoffs_reject_junk_and_keep_clean_documents(spark):
    data = labelled(spark, 2000, 50).union(labelled(spark, 20, 5, "fr")).union(labelled(spark, 1500, 5, None))
    cuts = quality.calibrate(data)
    assert set(cuts.by_stratum["en"]) == {"symbols"} and cuts.by_stratum["fr"] == {} and set(cuts.by_stratum[None]) == {"symbols"}
    out = quality.judged(data, cuts).groupBy("lang", "quality").agg({"kept": "max"}).collect()
    kept = {(r[0], r[1]): r[2] for r in out}
    assert kept["en", 1] and not kept["en", 0] and kept["fr", 0] and kept[None, 1] and not kept[None, 0]


def test_no_labels_reject_by_the_base_alone(spark, docs):
    from pyspark.sql import functions as F

    m = quality.measured(docs)
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    cuts = quality.calibrate(quality.labels_of(m, labels))
    assert quality.judged(m, cuts).where(F.col("kept") == F.col("base_failed")).count() == 0
