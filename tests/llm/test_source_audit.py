"""Source audit against a plain count, and odd rows."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievegrid.llm import source_audit


def plain(rows, least, top):
    lower = str.maketrans(source_audit.UPPER, source_audit.LOWER)
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(source_audit.TERM, (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        own = {s: share(c) for (x, s), c in counts.items() if x == lang}
        whole = share(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        for s, p in own.items():
            pairs = [(-sum(f(p[t], q[t]) for t in kept), o) for o, q in own.items() if o != s]
            terms = [(-f(p[t], whole[t]), t) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def test_same_as_plain(spark):
    words = ["the", "The", "éta", "Éta", "x1y", "日本", "a-b", "zu", "ZU", "\U0001f600"]
    rows = []
    for i in range(300):
        rows.append((" ".join(words[(i * j + j) % len(words)] for j in range(1 + i % 7)), ["en", "de", None, ""][i % 4], [f"s{i % 5}", None, "s1"][i % 3]))
    rows += [(None, "en", "empty"), ("", "en", "empty2"), ("lone words", "xx", "a"), ("other words", "xx", "b"), ("one", "yy", "a"), ("the " * 200_000, "en", "long")]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "text string, lang string, source string").select("*", F.lit(1).alias("term"), F.lit(2).alias("p"))
    got = source_audit.audit(df, least=5, top=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 3)
    assert source_audit.audit(df.where("false")).count() == 0
