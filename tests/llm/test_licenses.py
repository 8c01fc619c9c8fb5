"""Licence scans against a brute-force reading of the rule."""

import math
import re

from sunloom.llm import licenses as L


def brute(texts):
    """The labels of each text: every template at every place, over all of its words."""
    docs = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    vocabulary = {w for _, t, _ in L.TEMPLATES for w in t.split()} | {w for p in L.BASE for w in p.split()}
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1 for w in vocabulary}
    out = []
    for d in docs:
        labels = set()
        for label, template, key in L.TEMPLATES:
            t, k = template.split(), key.split()
            key_at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for start in range(-len(t), len(d)):
                agree = sum(idf[w] for i, w in enumerate(t) if 0 <= start + i < len(d) and d[start + i] == w)
                at = start + key_at
                if at >= 0 and d[at : at + len(k)] == k and round(agree / sum(idf[w] for w in t), 6) >= L.SHARE:
                    labels.add(label)
        out.append(sorted(labels))
    return out


def test_texts_with_many_licences(spark):
    by_label = {}
    for label, template, _ in L.TEMPLATES:
        by_label.setdefault(label, template)
    every = "\n\nfiller words between\n\n".join(t for _, t, _ in L.TEMPLATES)
    four = ". Then: ".join(by_label[x] for x in ("mit", "bsd", "gpl", "mpl-2"))
    texts = [every, four, by_label["gpl"], "some mozilla public license", "no terms at all here", None, "", f"{four} {four}", every.upper()]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()}
    want = brute([*texts, texts[0]])
    assert want[0] == sorted({label for label, _, _ in L.TEMPLATES}) and want[1] == ["bsd", "gpl", "mit", "mpl-2"]
    for i, labels in enumerate(want[: len(texts)]):
        assert [x["label"] for x in got[i]["found"]] == labels, i
    assert all(abs(x["score"] - 1) < 1e-6 for x in got[0]["found"])
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
