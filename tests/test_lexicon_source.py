"""The lexicon of the test tables: counted first, its rule read from the counted tokens only."""

import hashlib
import re
from collections import Counter

from riselens.sources import fixtures as fx


def test_lexicon_rule_is_applied_to_counted_tokens(spark, tmp_path):
    texts = ["Alpha beta, alpha!", "gamma be-ta Éclair", None, "", "rare"] * fx.LEXICON_MIN_COUNT + ["once", "rarer"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = fx._lexicon(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    counts = Counter(w for t in texts if t for w in re.split(r"[\W\d_]+", t.lower()) if len(w) >= fx.LEXICON_MIN_LEN)
    rule = {w: (ord(hashlib.md5(w.encode()).hexdigest()[0]) % 9 - 4) / 2 for w, n in counts.items() if n >= fx.LEXICON_MIN_COUNT}
    want = {w: v for w, v in rule.items() if v}
    assert want and {r["token"]: r["valence"] for r in got.collect()} == want
