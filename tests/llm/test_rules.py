import random
import re

import duckdb
import pytest

from pulsegrid.llm import line_rules as R
from pulsegrid.llm import queries
from pulsegrid.llm import url_templates as U
from tools_check import compare

from .fixtures import awkward, empty

RULES = queries.URL_RULES


@pytest.mark.parametrize("url,host,path", [
    ("HTTP://Ab.Ä.net/x/y?q#f", "ab.Ä.net", "/x/y"), ("a://b", "b", ""), ("a://b?c/d", "b", ""), ("a://b#c", "b", ""),
    ("a:///x", "", "/x"), ("nothing", "", ""), (None, "", ""), ("a://b/c://d/e", "b", "/c://d/e"), ("a://b/\nz?", "b", "/\nz"),
])
def test_split(spark, url, host, path):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    row = U.judge(df, RULES).first()
    assert (row.host, row.path) == (host, path)


@pytest.mark.parametrize("url,rule,verdict", [
    ("http://x.net/a", "net/", "block"), ("http://net/a", "net/", "block"), ("http://anet/a", None, "allow"), ("http://x.net", None, "allow"),
    ("http://example.net/en/1", "example.net/en/", "allow"), ("http://a.example.net/en/", "example.net/en/", "allow"), ("http://example.net/en", "net/", "block"),
    ("http://b.org/fr/", "org/fr/", "allow"), ("http://b.org/de/", None, "allow"), ("http://example.com/de/1", "example.com/de/", "block"),
])
def test_longest_rule(spark, url, rule, verdict):
    row = U.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), RULES).first()
    assert (row.rule, row.verdict) == (rule, verdict)


def site(seed=0, size=400):
    """Pages of two hosts; the labels know the spam branch of one."""
    rng = random.Random(seed)
    out = []
    for i in range(size):
        host = rng.choice(["a.test", "b.test"])
        branch = rng.choice(["news", "shop", "spam"])
        out.append((i, f"http://{host}/{branch}/{i * 7}/page", int(branch == "spam") if host == "a.test" and rng.random() < 0.4 else None))
    return out


def test_learned_templates(spark):
    df = spark.createDataFrame(site(), "page_id long, url string, bad int")
    got = U.judge(df, (), label=df["bad"]).collect()
    for r in got:
        assert r.verdict == ("block" if r.host == "a.test" and "/spam/" in r.path else "allow")
        assert r.template.split("/")[2] == "*"
    assert len({r.template for r in got if r.host == "b.test"}) == 1


@pytest.mark.parametrize("depth", [4])
def test_templates_equal_sql(spark, depth):
    rng = random.Random(5)
    rows = [(i, rng.choice(["http://", "ftp://", ""]) + rng.choice(["a.net", "example.com", "b.org", "example.net"]) + "/" + "/".join(rng.choice(["en", "de", "fr", str(rng.randint(0, 50)), ""]) for _ in range(rng.randint(0, 6)))) for i in range(600)]
    rows += [(None, "http://a.net/x"), (601, None), (601, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    pages = df.toPandas()  # noqa: F841  read by name below
    assert compare(U.judge(df, RULES).toPandas(), duckdb.sql(U.judge_sql(RULES)).df()) is None


def test_deep_paths_are_learned(spark):
    rows = [(i, f"http://a.test/2024/05/12/shop/{'spam' if i % 2 else 'good'}/{i * 7}", i % 2) for i in range(40)]
    got = U.judge(df := spark.createDataFrame(rows, "page_id long, url string, bad int"), (), label=df["bad"], depth=None).collect()
    assert {(r.template, r.verdict) for r in got} == {("/{l}/{l}/{l}/{l}/spam/*", "block"), ("/{l}/{l}/{l}/{l}/good/*", "allow")}


def test_all_levels_equal_sql(spark):
    rng = random.Random(6)
    rows = [(i, "http://" + rng.choice(["a.net", "example.com"]) + "/" + "/".join(rng.choice(["en", "de", str(rng.randint(0, 90))]) if k > 3 else "x" for k in range(rng.randint(0, 9)))) for i in range(400)]
    rows += [(1000, "http://deep.test/" + "/".join("abcdefghijklmnop"))]
    df = spark.createDataFrame(rows, "page_id long, url string")
    pages = df.toPandas()  # noqa: F841  read by name below
    assert compare(U.judge(df, RULES, depth=None).toPandas(), duckdb.sql(U.judge_sql(RULES, depth=16)).df()) is None


def test_url_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("id", "host", "path", "label", "part", "n", "template")})
    assert U.judge(df, RULES).count() == 1 and U.judge(df.limit(0), RULES).count() == 0


def plain_repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_repeated_words():
    rng = random.Random(7)
    for _ in range(500):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 25))]
        assert R.repeated_words(words) == plain_repeats(words)


def test_base_figures(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(["ab ", "é", "\n", "#", "x y z ", "\x0b", "\x1c", "\u2003", "<|"], k=rng.randint(0, 60))), "h") for i in range(200)]
    for r in R.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        text = rows[r.doc_id][1]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), plain_repeats(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))


def test_depleted_documents_go_and_copies_do_not_count(spark):
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    footer = line() + " " + line()
    rows = [(i, f"{line()}\n{line()}\n{line()}\n{footer.upper() if i % 2 else footer}", "h") for i in range(60)]
    rows += [(100 + i, f"{footer}\nfew words {i}", "h") for i in range(5)]
    copied = f"{line()}\n{line()}"
    rows += [(200 + i, copied, "h") for i in range(90)]
    got = {r.doc_id: r for r in R.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].n_common_words == 60 for i in range(60))
    assert not any(got[100 + i].kept for i in range(5)) and all(got[200 + i].kept for i in range(90))
    assert R.judge(awkward(spark)).count() == 9 and R.judge(empty(spark)).count() == 0


def test_common_lines_leave_the_texts(spark):
    rng = random.Random(10)
    # Letters, as digits are the same in a normalised line.
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
    ends = [line() for _ in range(40)]
    footer = line()
    own = [f"{line()}\n\n{line()}\n" for _ in range(40)]
    rows = [(i, f"{t}{footer.upper() if i % 2 else footer}\n{ends[i]}", "h") for i, t in enumerate(own)] + [(50, f"{footer}\nfew", "h"), (50, f"{footer}\nfew", "h"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in R.clean(df).collect()}
    assert all(got[i].text == t + ends[i] and got[i].n_common_words == 30 and got[i].kept for i, t in enumerate(own))
    assert got[50].text == "few" and not got[50].kept and got[None].text is None and R.clean(df).count() == 43
    judged = sorted((str(r.doc_id), r.n_common_words, r.kept) for r in R.judge(df).collect())
    assert judged == sorted((str(r.doc_id), r.n_common_words, r.kept) for r in R.clean(df).collect())
    assert R.clean(awkward(spark)).count() == 9 and R.clean(empty(spark)).count() == 0
