"""Operators 11 to 13 against plain versions, and the odd cases their docstrings name."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evalspark.llm import conversation, queries, runs, url_filter
from evalspark.llm.common import table
from tests import oracle

TINY = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11 periodic runs ----------------------------------------------------------

def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_of_random_texts():
    draw = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(1, 6)):
            n = draw.choice([0, 1, 5, 30, 100, 400])
            words = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(n)]
            for _ in range(draw.randint(0, 3) if n > 4 else 0):
                start, period = draw.randrange(n), draw.randint(1, draw.choice([12, max(1, n // 4)]))
                for i in range(start + period, min(n, start + draw.randint(2, 7) * period + draw.randint(0, period))):
                    words[i] = words[i - period]
            texts.append(words)
        assert runs.find_runs(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("period", [1, 7, 8, 9, 16, 17, 31, 32, 33, 64, 65, 500])
def test_every_period_is_found_at_four_times(period):
    draw = random.Random(period)
    root = [draw.randrange(10**6) for _ in range(period)]
    around = [draw.randrange(10**6, 10**7) for _ in range(40)]
    for length in (4 * period - 1, 4 * period, 4 * period + 3):
        text = around[:20] + [root[i % period] for i in range(length)] + around[20:]
        assert runs.find_runs([text]) == [plain_runs(text)]
        assert len(runs.find_runs([text])[0]) == (length >= max(6, 4 * period))


def test_op11_over_whole_texts(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, TINY).collect()}
    docs = table(spark, TINY, "documents").collect()
    assert len(got) == len(docs)
    for doc in docs:
        words = WORDS.findall(doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a, old = h // 10 % n, list(words)
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join("%d,%d,%d\n" % r for r in found)
        milli = 1000 * best[1] // best[2] if found else None
        assert got[doc.doc_id] == (len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_odd_rows(spark):
    rows = [(None, None, 1), (1, None, 2), (2, "", 3), (3, " \n\t ", 4), (4, "a " * 100_000, 5), (4, "a " * 100_000, 5), (5, "x\u00a0y x\u00a0y z", 6)]
    out = runs.with_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"))
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0), [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert got == [(0, [], ""), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 100_000, 1)], "a"), (4, [(0, 100_000, 1)], "a"), (5, [], "x\u00a0y x\u00a0y z")]
    none = runs.with_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and none.columns == ["doc_id", "text", "runs", "collapsed"]


# --- 12 conversations ----------------------------------------------------------

FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """Rows (turn, role, text) in order; every order of edits is tried."""
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0d]", text)
        faults.append(1 if not marks else 2 if (role, text) in seen else 3 if marks[-1] not in ".!?" else 0)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @functools.lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        news = [role for role in ("user", "assistant") if (state, role[0]) in FOLLOWS]
        if inserted < 3:
            for role in news:
                cost, audit, lines = best(i, FOLLOWS[state, role[0]], inserted + 1)
                options.append((cost + 5, "I" + audit, ((role, ""), *lines)))
        if i < len(rows):
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, lines))
            if faults[i] in (0, 3):
                more = 5 if faults[i] == 3 else 0
                for role, edit, own in [(rows[i][1], "K", 0), *((role, "R", 1) for role in news)]:
                    if (state, role[:1]) in FOLLOWS:
                        cost, audit, lines = best(i + 1, FOLLOWS[state, role[:1]], 0)
                        options.append((cost + own + more, edit + audit, ((role, rows[i][2]), *lines)))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{x}" for r, x in lines)
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out.setdefault(conv, []).extend([row] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: plain_repair(in_order(rs)) for c, rs in out.items()}


def test_op12_over_the_table(spark):
    rows = [tuple(r) for r in table(spark, TINY, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, TINY).collect()}
    assert got == damaged(rows)


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_a_conversation_over_many_blocks(spark, tmp_path, monkeypatch, blocks):
    """One conversation and the NULL one hold most rows; there are NULLs, ties, repeats, and unknown and empty roles."""
    monkeypatch.setattr(conversation, "_PIECE_ROWS", 7)
    draw = random.Random(blocks)
    texts = ["Hi.", "ok", " ", "", None, "What?", "a b c", "fine!  ", "x" * 70 + ".", "x" * 70 + "a."]
    rows = [(draw.choice([None, 7, 7, 7, 8, *range(20, 40)]), draw.choice([None, *range(60)]),
             draw.choice(["user", "assistant", "system", "assistant", "user", None, "tool", ""]), draw.choice(texts)) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(conversation.repair, "__defaults__", (*conversation.repair.__defaults__[:-1], blocks))
    got = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == damaged(rows) and len(got) == len({r[0] for r in rows})


def test_repaired_rows_are_legal_and_in_order(spark):
    rows = [(1, n, "user" if n % 3 else "assistant", f"Line {n}.") for n in range(50)] + [(2, 0, "user", "Alone?")]
    pieces = conversation.repair(spark.createDataFrame(rows, "id int, at int, who string, said string"), "id", "at", "who", "said", blocks=4)
    lines = conversation.repaired_rows(pieces).orderBy("conv", "block", "piece", "line").collect()
    said = {c: [r for r in lines if r.conv == c] for c in (1, 2)}
    for c in said:
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in said[c]))
    assert [(r.role, r.text) for r in said[2]] in ([], [("user", "Alone?"), ("assistant", "")])
    kept = [int(r.text[5:-1]) for r in said[1] if r.text]
    assert kept == sorted(kept)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.reports(conversation.repair(none)).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "x.")], none.schema)
    row = conversation.reports(conversation.repair(gone, present=F.lit(False))).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- 13 URLs -------------------------------------------------------------------

ODD_URLS = [None, "", "no scheme/at all", "http://", "://A.NET/x", "http://Example.NET/en/1", "http://example.net/en", "http://notexample.net/en/",
            "https://a.b.org/fr/?q#z", "http://org?/fr/", "http://x.example.com/de/5#", "http://example.com", "HTTP://É.org/fr/x", "a://b://c/d"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_parts_and_rules_of_odd_urls(spark):
    rows = spark.createDataFrame([(n, u) for n, u in enumerate(ODD_URLS)], "n int, url string")
    got = url_filter.judged(rows, queries.URL_RULES).collect()
    assert len(got) == len(ODD_URLS)
    for r in got:
        host, path = parts(r.url)
        fits = [x for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def plain_verdicts(urls, order=4, alphabet=256):
    """(url, verdict) of those without a rule, by counting in dictionaries."""
    labelled = {}
    for url in urls:
        host, path = parts(url)
        fits = [x for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        text = host + re.sub(r"^[^/?#]*", "", url.split("://", 1)[1]) if url and "://" in url else url or ""
        labelled[text, rule and rule.verdict] = url
    held = {t for t, v in labelled if v and hashlib.md5(t.encode()).hexdigest()[-1] in "012"}

    def grams(text):
        padded = "\x02" * order + text + "\x03"
        return [padded[i:i + order + 1] for i in range(len(text) + 1)]

    def model(verdict, without):
        seen = {}
        for text in {t for t, v in labelled if v == verdict and t not in without}:
            for gram in grams(text):
                for k in range(order + 1):
                    seen.setdefault(gram[order - k:order], Counter())[gram[order]] += 1

        def p(gram):
            value = 1 / alphabet
            for k in range(order + 1):
                after = seen.get(gram[order - k:order])
                if after:
                    value = (after[gram[order]] + len(after) * value) / (sum(after.values()) + len(after))
            return value
        return p

    def scorer(without):
        a, r = model("allow", without), model("block", without)
        return lambda t: sum(round((math.log(a(g)) - math.log(r(g))) * 1e6) for g in grams(t)) / len(grams(t)) / 1e6

    fit, whole = scorer(held), scorer(set())
    sides = {v: [fit(t) for t, w in labelled if w == v and t in held] for v in ("allow", "block")}
    mean = {v: sum(s) / len(s) for v, s in sides.items()}
    dev = {v: math.sqrt(sum((x - mean[v]) ** 2 for x in s) / len(s)) for v, s in sides.items()}
    least = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"])
    hits = sum((x >= least) == (v == "allow") for v, s in sides.items() for x in s)
    return {t: ("allow" if whole(t) >= least else "block") for t, v in labelled if v is None}, hits / sum(map(len, sides.values()))


def test_op13_against_counting(spark):
    urls = [r.url for r in table(spark, "/root/testdata/sf0.01", "pages").select("url").collect()]
    want, accuracy = plain_verdicts(urls)
    assert accuracy >= 0.9  # of held-out URLs
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(urls + urls[:20])], "page_id long, url string, verdict string")
    got = url_filter.judged(pages, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    rows = got.collect()
    assert len(rows) == len(urls) + 20
    for r in rows:
        if r.rule is None:
            assert r.verdict == want[r.host + re.sub(r"^[^/?#]*", "", r.url.split("://", 1)[1])]


def test_no_urls_and_one_sided_rules(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).collect() == []
    rows = spark.createDataFrame([(1, "http://a.org/fr/1"), (2, "http://a.org/en/1")], "page_id long, url string")
    assert {r.verdict for r in url_filter.judged(rows, ()).collect()} <= {"allow", "block"}
    assert {r.page_id: r.verdict for r in url_filter.judged(rows, queries.URL_RULES).collect()}[1] == "allow"


def test_a_very_long_url(spark):
    rows = spark.createDataFrame([(1, "http://a.com/" + "x/" * 100_000), (2, "http://b.net/"), (3, "http://b.org/fr/1")], "page_id long, url string")
    assert {r.page_id: len(r.path) for r in url_filter.judged(rows, queries.URL_RULES).collect()}[1] == 200_001


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_url_markov"])
def test_sql_twins(spark, name):
    assert oracle.difference(queries.QUERIES[name](spark, TINY), oracle.connect(TINY), queries.ORACLES[name]) is None
