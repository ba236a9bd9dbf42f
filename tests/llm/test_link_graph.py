"""Trust over link graphs against a dense solve, and long chains."""

import numpy as np
import pytest

from strataloom.llm import url_filter
from strataloom.llm.common import Scratch


def _dense(n, edges, seeds, damping=0.85):
    """The fixed point by linear algebra."""
    m, out = np.zeros((n, n)), np.zeros(n)
    for a, _, k in edges:
        out[a] += k
    for a, b, k in edges:
        m[b, a] += k / out[a]
    return np.linalg.solve(np.eye(n) - damping * m, (1 - damping) * seeds)


@pytest.mark.parametrize("links", [260, 700])
def test_against_a_dense_solve(spark, links):
    """Random graphs of 300 hosts: sparse ones are mostly chains and cycles of hosts with one link in."""
    rng, n = np.random.default_rng(links), 300
    pairs = {(int(a), int(b)): int(k) for a, b, k in zip(rng.integers(0, n, links), rng.integers(0, n, links), rng.integers(1, 5, links))}
    pairs |= {(290, 291): 1, (291, 292): 2, (292, 290): 1, (280, 280): 3}
    edges = [(a, b, k) for (a, b), k in pairs.items()]
    seeds = np.zeros(n)
    seeds[rng.choice(n, 12, replace=False)] = 1 / 12
    want = _dense(n, edges, seeds)
    e = spark.createDataFrame([(f"h{a}", f"h{b}", k) for a, b, k in edges], "src string, dst string, n long")
    s = spark.createDataFrame([(f"h{i}", float(seeds[i])) for i in np.flatnonzero(seeds)], "host string, seed double")
    got = {r["host"]: np.exp(r["log_rank"]) for r in url_filter.log_ranks(e, s, Scratch(spark), 0.85).collect()}
    assert set(got) == {f"h{i}" for i in np.flatnonzero(want > 1e-15)}
    assert all(got[f"h{i}"] == pytest.approx(want[i], rel=1e-6) for i in range(n) if want[i] > 1e-15)


def test_a_chain_of_thousands_of_hosts(spark):
    """Each links to the one before; the first is blocked, so all are. Ranks this small are no numbers any more."""
    n = 6000
    rows = [(0, "http://spam.net/", "")] + [(k, f"http://h{k}.info/", f'<a href="http://{f"h{k - 1}.info" if k > 1 else "spam.net"}/">l</a>') for k in range(1, n)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).groupBy("verdict", "trust").count().collect()
    assert [tuple(r) for r in got] == [("block", 0.0, n)]


def test_hosts_that_differ_in_more_than_letters(spark):
    """Ports and user names belong to the host as it is written; letters outside of A to Z keep their case."""
    rows = [(1, "http://user@A.net:80/x", ""), (2, "http://ÉCOLE.org/fr/a", ""), (3, "http://a.net/x", "")]
    got = {r["page_id"]: (r["host"], r["rule"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("user@a.net:80", None), 2: ("École.org", "org/fr/"), 3: ("a.net", "net/")}
