"""Licence scans: cosines by definition, and inheritance by path."""

import math
import re
from collections import Counter

from tallyforge.llm import licences
from pyspark.sql import functions as F


def model_cosines(lines):
    docs = [(t, 1) for t in licences.TEMPLATES.values()] + list(lines.items())
    terms = lambda t: Counter(x for x in re.split("[^a-z0-9]+", t.lower()) if x)
    df, total = Counter(), sum(n for _, n in docs)
    for t, n in docs:
        for x in terms(t):
            df[x] += n
    def vec(t):
        v = {x: k * (math.log((total + 1) / (df[x] + 1)) + 1) for x, k in terms(t).items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / size for x, w in v.items()}
    out = {}
    for line in lines:
        v = vec(line)
        scores = {k: sum(w * u.get(x, 0) for x, w in v.items()) for k, u in ((k, vec(t)) for k, t in licences.TEMPLATES.items())}
        best = max(scores, key=lambda k: (round(scores[k], 9), [-ord(c) for c in k]))
        if scores[best] >= licences.THRESHOLD:
            out[line] = best, scores[best]
    return out


def test_scan(spark):
    mit, apache, nc = (licences.TEMPLATES[k] for k in ("MIT", "Apache-2.0", "CC-BY-NC-4.0"))
    files = [("LICENSE", mit), ("a/x.py", "code\n" + apache + "\nmore"), ("a/b/NOTICE.txt", "text\n " + nc), ("a/b/c/d.py", "print"),
             ("a/b/e.py", None), ("a/z.py", ""), ("a/b/c/own.py", "the " + mit + " "), ("odd.py", "my driving licence is old and was lost"),
             (None, "nothing"), ("q/r/s.py", "x" * 100000), ("q/r/s.py", "again")]
    df = spark.createDataFrame([(t, p, "n") for p, t in files], "text string, path string, licence string")
    out = licences.scan(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["path"], r["licence"], r["inherited_from"]) for r in out.collect()), key=repr)
    assert got == sorted([("LICENSE", "MIT", None), ("a/x.py", "Apache-2.0", None), ("a/b/NOTICE.txt", "CC-BY-NC-4.0", None),
                          ("a/b/c/d.py", "CC-BY-NC-4.0", "a/b"), ("a/b/e.py", "CC-BY-NC-4.0", "a/b"), ("a/z.py", "MIT", ""),
                          ("a/b/c/own.py", "MIT", None), ("odd.py", "MIT", ""), (None, None, None), ("q/r/s.py", "MIT", ""),
                          ("q/r/s.py", "MIT", "")], key=repr)
    lines = Counter(x.strip() for _, t in files if t for x in t.split("\n") if re.search(licences.HEADER, x))
    found = licences.detect(spark.createDataFrame(list(lines.items()), "line string, n long")).collect()
    want = model_cosines(lines)
    assert {r["line"]: r["licence"] for r in found} == {k: v[0] for k, v in want.items()}
    assert all(abs(r["cosine"] - want[r["line"]][1]) < 1e-6 for r in found)
    assert licences.scan(df.limit(0)).count() == 0


def test_documents_as_files(spark):
    docs = spark.createDataFrame([(40000, "s", "Released under the MIT License."), (41003, "s", "x"), (41050, "s", "Licensed under CC BY 4.0."),
                                  (41051, "s", "y"), (5, None, None)], "doc_id long, source string, text string")
    out = licences.scan(licences.as_files(docs), licence_file=F.col("speaks"))
    assert {r["path"]: r["licence"] for r in out.collect()} == {
        "s/40000.txt": "MIT", "s/41/820/41003.txt": "MIT", "s/41/821/41050.txt": "CC-BY-4.0", "s/41/821/41051.txt": "CC-BY-4.0", "none/0/0/5.txt": None}
