"""Word and suffix patterns against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from listwarden import PublicSuffixes, default_config, flag_table
from listwarden.functions import text, trie
from listwarden.operators.domains import with_registrable_domains


def test_longest_word_at_a_place():
    r = random.Random(1)
    for _ in range(200):
        words = {"".join(r.choice("ab.+") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12))}
        pattern, body = re.compile(trie.longest_word(words)), "".join(r.choice("ab.+") for _ in range(30))
        for at in range(30):
            found = pattern.match(body, at)
            fitting = [word for word in words if body.startswith(word, at)]
            assert (found.group() if found else None) == max(fitting, key=len, default=None)
    assert [trie.overlaps_itself(w) for w in ("aa", "aba", "abab", "ab", "a", "roof")] == [True] * 3 + [False] * 3


def test_repeated_words(spark):
    r = random.Random(2)
    words = ["ana", "banana", "an", "aa", "aaaa", "roof", "roofing", "roofin g", "g r", "x.y", "[a]", "über", "🙂🙂", "of"]
    bodies = ["", "x", "a" * 50, "banana" * 9, "roofing roof roofer roofing", "über x.y [a] über 🙂🙂🙂🙂 x.y [a]"]
    bodies += [" ".join(r.choice([*words, "z", "nan"]) for _ in range(r.randrange(40))) for _ in range(60)]
    frame = spark.createDataFrame([(b,) for b in bodies], "b string")
    for times in (1, 2, 3):
        got = frame.select("b", text.repeated_words(F.col("b"), words, times).alias("w")).collect()
        assert all(row.w == [word for word in words if row.b.count(word) >= times] for row in got)


def test_few_words_are_searched_in_bytes(spark):
    """A handful of words need no pattern; the result is that of counting them."""
    r = random.Random(3)
    words = ["tion", "ment", "ana", "über", "x.y", "🙂🙂", "ti"]
    bodies = ["", "tion", "tiontion", "anana", "ananana", "🙂" * 3, "🙂" * 4, "überüber x.yxxy x.y"]
    bodies += ["".join(r.choice([*words, "n", "z ", "t"]) for _ in range(r.randrange(20))) for _ in range(80)]
    frame = spark.createDataFrame([(b,) for b in bodies], "b string")
    for times in (1, 2, 3):
        few = frame.select("b", text.repeated_words(F.col("b"), words, times).alias("w"))
        assert "regexp" not in few._jdf.queryExecution().executedPlan().toString()
        assert all(row.w == [word for word in words if row.b.count(word) >= times] for row in few.collect())
        more = [*words, *(f"w{at}q" for at in range(text.FEW_WORDS))]
        many = frame.select("b", text.repeated_words(F.col("b"), more, times).alias("w"))
        assert sorted(many.collect()) == sorted(few.collect())


def test_many_keywords_take_one_pass(spark):
    """A text of 1 MB and 1000 service words."""
    words = [f"word{at:04d}service" for at in range(1000)]
    body = " ".join(words[at * 7 % 500] for at in range(60_000))
    assert len(body) > 900_000
    frame = spark.createDataFrame([(1, "", body)], "row_id long, city string, description string")
    cfg = default_config().replace(high_risk_industries=words)
    start = time.perf_counter()
    row, = flag_table(frame, cfg, id_col="row_id", flags=["DESCRIPTION_KEYWORD_STUFFED"]).collect()
    assert row.detail.endswith(str(words[:5])) and time.perf_counter() - start < 20


def plain_domain(host, rules):
    labels = host.split(".") if host else []
    tails = [(".".join(labels[-n:]), n) for n in range(1, len(labels) + 1)]
    depth = next((n - 1 for tail, n in tails if "!" + tail in rules), None)
    if depth is None:
        found = [n for tail, n in tails if tail in rules]
        found += [n + 1 for tail, n in tails if "*." + tail in rules and len(labels) > n]
        depth = max(found, default=None)
    return ".".join(labels[-depth - 1:]) if depth is not None and len(labels) > depth else ""


@pytest.mark.parametrize("seed", range(6))
def test_domains(spark, seed):
    r = random.Random(seed)
    name = lambda: ".".join(r.choice(["a", "b", "ab", "c-d", "x"]) for _ in range(r.randrange(1, 5)))
    rules = {r.choice(["", "", "*.", "!"]) + name() for _ in range(r.randrange(0, 25))}
    rules = {rule for rule in rules if not rule.startswith("!") or rule.count(".")}
    # of two exceptions within each other only the shorter one can be meant
    hosts = ["", "a", "b.a.x", *[name() for _ in range(120)], *[f"{name()}.{name()}" for _ in range(120)]]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffixes = PublicSuffixes.from_rules(spark, rules) if rules else PublicSuffixes(spark.createDataFrame([], "suffix string, kind string"))
    out = with_registrable_domains(frame, {"domain": F.col("host")}, suffixes)
    assert out.columns == ["host", "domain"]
    assert [(x.host, x.domain) for x in out.collect()] == [(h, plain_domain(h, rules)) for h in hosts]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_long_suffix_list(spark):
    """As many rules as the public list has, all in one pattern."""
    rules = [f"s{at}.t{at % 1500}" for at in range(9000)] + [f"t{at}" for at in range(1500)]
    suffixes = PublicSuffixes.from_rules(spark, rules)
    frame = spark.range(200_000).select(
        F.concat(F.lit("www.shop.s"), F.col("id") % 12_000, F.lit(".t"), F.col("id") % 1500).alias("host"))
    out = with_registrable_domains(frame, {"domain": F.col("host")}, suffixes)
    start = time.perf_counter()
    labels = out.groupBy((F.length("domain") - F.length(F.replace("domain", F.lit("."), F.lit("")))).alias("dots")).count()
    assert {row.dots: row["count"] for row in labels.collect()} == {
        1: sum(i % 12_000 >= 9000 for i in range(200_000)), 2: sum(i % 12_000 < 9000 for i in range(200_000))}
    assert time.perf_counter() - start < 30
