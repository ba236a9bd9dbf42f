"""Phrase collocations against SQL and a plain count."""

import re
from collections import Counter
from itertools import pairwise

import pytest

from strataloom.llm import collocations as c
from strataloom.llm import grams
from tests.llm.test_operators import DOCS, ODD


def _plain(rows, max_words, least, share, most):
    counts, total = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, max_words + 1):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in good.items():
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items())
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), left, right))
        best.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(best[:most])]
    return sorted(out)


@pytest.mark.parametrize("max_words, least, most, bits", [(3, 2, 2000, c.MAP_BITS), (5, 3, 7, c.MAP_BITS), (4, 2, 50, 64)])
def test_against_a_plain_count(spark, monkeypatch, max_words, least, most, bits):
    """Also with a bit map so small that it lets nearly everything through."""
    monkeypatch.setattr(c, "MAP_BITS", bits)
    monkeypatch.setattr(c, "PART_BITS", min(bits, c.PART_BITS))
    words = "to be or not in The the new york city of a b \x00 été".split(" ")
    rows = [("en" if i % 3 else None, " ".join(words[(i * i + j * j // 3) % len(words)] + (". " if j % 7 == 6 else "") for j in range(40)) + "\nnew york city\tnew york") for i in range(60)]
    rows += [("en", "new york city new york city; new york"), ("en", None), ("fr", ""), ("fr", "  .\n"), ("de", "ab ab ab ab ab")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = c.collocations(docs, max_words=max_words, least=least, most=most).collect()
    assert sorted(map(tuple, got)) == _plain(rows, max_words, least, c.SHARE, most) and len(got) > 10


def test_odd_tables(spark):
    odd, empty = spark.createDataFrame(ODD, DOCS).withColumnsRenamed({"n_chars": "n", "score": "phrase", "size": "rank"}), spark.createDataFrame([], DOCS)
    assert c.collocations(empty).count() == 0
    assert sorted(map(tuple, c.collocations(odd).collect())) == _plain([(r[2], r[1]) for r in ODD], 3, 10, 50, 2000)
    assert {r["phrase"] for r in c.collocations(odd).collect()} == {"wordy wordy wordy"}


def test_products_pass_64_bits(spark):
    """A phrase whose counts multiply to more than 2 ** 63, from counts themselves."""
    n = 5_000_000_000
    df = spark.createDataFrame([(n, n + 1, n + 3)], "a long, l long, r long")
    a, left, right = ("cast(%s as decimal(15,0))" % x for x in "alr")
    got = df.selectExpr(f"cast(cast(1000000 as decimal(7,0)) * ({a} * {a}) as decimal(38,0)) div ({left} * {right}) AS s").first()[0]
    assert got == 1000000 * n * n // ((n + 1) * (n + 3))


def test_cut():
    import pyarrow as pa

    texts = pa.array(["Ab c", None, "", "d", "é.f,g  Ab", " x"]).slice(0)
    for given, shift in ((texts, 0), (pa.concat_arrays([pa.array(["zz. q"]), texts]).slice(1), 0)):
        w = grams.cut(given, b" ", b".,")
        assert [w.vocabulary[int(i)].as_py().decode() for i in w.ids] == ["ab", "c", "d", "é", "f", "g", "ab", "x"]
        assert w.text.tolist() == [0, 0, 3, 4, 4, 4, 4, 5] and [a == b for a, b in pairwise(w.piece.tolist())] == [True, True, True, False, False, True, True]
    assert list(grams.slices(pa.array(["aaa", None, "bb", "c" * 20, "d"]), 5)) == [(0, 3), (3, 4), (4, 5)]
