import random
from datetime import date, timedelta

from kestrel.llm import url_lists as U

DAY = date(2024, 1, 1)
CAPTURES = "page_id long, url string, fetched_on date, host string, domain string"


def brute(url, day, entries):
    import re
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = m[1].lower().removesuffix(".") if m else ""
    labels = host.split(".")
    for i in range(len(labels) - 1):
        d = ".".join(labels[i:])
        past = [(on, U.RANK[s]) for dom, on, s in entries if dom is not None and dom.lower() == d and on is not None and s in U.RANK and day is not None and on <= day]
        if past:
            on, rank = max(past)
            if rank > 1:
                return host, {3: "block", 2: "allow"}[rank], d, on
    return host, "pass", None, None


def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark):
    rnd = random.Random(7)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.example.org", "example.org", "single", "Y.Example.ORG."]
    urls = [f"{rnd.choice(['http', 'https'])}://{rnd.choice(['', 'me@'])}{h}{rnd.choice(['', ':80'])}{rnd.choice(['', '/p?q', '#f'])}" for h in hosts for _ in range(4)]
    urls += [None, "", "no scheme", "http://", "ftp://u:p@example.com/x"]
    rows = [(k, rnd.choice(urls), DAY + timedelta(rnd.randint(0, 30)), "h", "d") for k in range(300)]
    rows += [(400, urls[0], None, "h", "d"), (None, urls[1], DAY, "h", "d"), rows[0], rows[0]]
    entries = [(rnd.choice([*hosts, None, "EXAMPLE.com"]), rnd.choice([None, DAY + timedelta(rnd.randint(0, 30))]), rnd.choice(["block", "allow", "off", None, "odd"])) for _ in range(80)]
    out = U.judge(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, "domain string, listed_on date, state string"))
    got = sorted(((r.page_id, r.url, r.fetched_on, r.host, r.verdict, r.matched, r.since) for r in out.collect()), key=str)
    want = sorted(((p, u, on, *brute(u, on, entries)) for p, u, on, _, _ in rows), key=str)
    assert got == want and {r[4] for r in got} == {"block", "allow", "pass"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], CAPTURES)
    entries = spark.createDataFrame([], "domain string, listed_on date, state string")
    assert U.judge(none, entries).collect() == []
    one = spark.createDataFrame([(1, "http://a.b", DAY, "h", "d")], CAPTURES)
    assert [r.verdict for r in U.judge(one, entries).collect()] == ["pass"]


def test_time_of_day_counts(spark):
    from datetime import datetime
    at = lambda h, d=1: datetime(2024, 1, d, h)
    entries = [("a.b", at(9), "block"), ("a.b", at(18), "off"), ("x.a.b", at(12), "allow"), ("a.b", at(7, 3), "allow"), ("a.b", at(7, 3), "block")]
    rows = [(k, f"http://{h}/", t) for k, (h, t) in enumerate([("a.b", at(8)), ("a.b", at(9)), ("a.b", at(20)), ("x.a.b", at(10)), ("x.a.b", at(13)), ("x.a.b", at(19, 2)), ("a.b", at(1, 3)), ("a.b", at(23, 3))])]
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string, fetched_on timestamp"), spark.createDataFrame(entries, "domain string, listed_on timestamp, state string"))
    got = [(r.verdict, r.matched, r.since) for r in out.orderBy("page_id").collect()]
    assert got == [("pass", None, None), ("block", "a.b", at(9)), ("pass", None, None), ("block", "a.b", at(9)), ("allow", "x.a.b", at(12)), ("allow", "x.a.b", at(12)),
                   ("pass", None, None), ("block", "a.b", at(7, 3))]
