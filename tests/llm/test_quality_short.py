import numpy as np

from sedimark.llm import quality as Q


def test_short_junk_is_rejected(spark):
    r = np.random.default_rng(3)
    syllables = ["ba", "de", "li", "mo", "nu", "sa", "te"]
    say = lambda n: " ".join("".join(r.choice(syllables, 2)) for _ in range(n))
    rows = [(i, say(25 if i % 2 else 300), "x") for i in range(160)] + [(200, " ".join("".join(map(chr, r.integers(97, 123, 4))) for _ in range(25)), "x")]
    found = Q.judge_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(rows[-1][1]) < 200 and [d.doc_id for d in found if not d.kept] == [200]
    assert all(d.log_perplexity is not None for d in found)
