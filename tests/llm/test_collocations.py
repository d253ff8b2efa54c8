import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from kmerloom.llm.collocations import collocations
from kmerloom.llm.queries import ORACLES, op11_collocations

STOPS, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def brute(rows, least, top, most=4, absorb=(80, 100)):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in STOPS.split(low):
            w = tuple(WORD.findall(piece))
            for m in range(1, most + 1):
                counts["und" if lang is None else lang].update(w[i : i + m] for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for q in range(2, len(p)):
                for i in range(len(p) - q + 1):
                    longer[p[i : i + q]] = max(longer[p[i : i + q]], a)
        scored = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if absorb[1] * longer[p] < absorb[0] * a:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcDEé漢") for _ in range(rnd.randint(1, 4))) for _ in range(25)]
    phrases = [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 6))) for _ in range(8)]
    ends = [" ", " ", "\t", "  ", ". ", ", ", "\n", "!", " ; ", "\x0b", "\r\n", "\x85", "\xa0", "\x1c"]
    out = []
    for i in range(120):
        parts = [rnd.choice([rnd.choice(words), rnd.choice(words), rnd.choice(phrases)]) + rnd.choice(ends) for _ in range(rnd.randint(0, 40))]
        out.append((["en", "en", "de", None, "und", ""][i % 6], "".join(parts)))
    out += [("en", None), (None, ""), ("fr", "one two"), ("en", " \t\n .,"), ("xx", None), ("en", "the the the " * 3000), ("de", out[2][1]), ("de", out[2][1])]
    out.append(("en", " ".join(rnd.choice(words) for _ in range(20_000))))
    return out


def table(spark, rows):
    own = [(lang, text, k, None if k % 2 else "w") for k, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(own, "lang string, text string, n long, word string")


def collected(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("least,top,most,budget", [(3, 50, 4, 1 << 20), (3, 50, 4, 400), (2, 2000, 3, 40), (5, 10, 2, 4000)])
def test_equals_brute_force(spark, rows, least, top, most, budget):
    """Under small budgets most words are above them, so that prefixes of every length choose groups."""
    want = brute(rows, least, top, most)
    assert len(want) > 20
    assert collected(collocations(table(spark, rows).repartition(5), least, top, most, budget=budget)) == want


def test_absorbing_shares(spark, rows):
    assert collected(collocations(table(spark, rows), 3, 100, absorb=(1, 2))) == brute(rows, 3, 100, absorb=(1, 2))


def test_empty_and_bad(spark, rows):
    assert collocations(table(spark, rows).where("n < 0")).collect() == []
    assert collocations(table(spark, [("en", None), (None, " . ")])).collect() == []
    with pytest.raises(ValueError):
        collocations(table(spark, rows), most=5)


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], 30, 2000)
    assert collected(op11_collocations(spark, folder)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.sql(ORACLES["op11_collocations"]).df()
    assert sorted(map(tuple, found[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False))) == want
    assert isinstance(found, pd.DataFrame) and len(found)
