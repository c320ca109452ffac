"""CSV files against Python's own reader: line breaks in quotes across splits, doubled quotes, ISO-8859-1, blank lines."""

import csv
import io
import random

import pytest

from tallyforge.sources import ingest


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines each."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "150")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def read(spark, path):
    df = ingest.read_csv(spark, str(path))
    names = [c for c in df.columns if c not in ("_corrupt_record", "source_file", "ingest_seq")]
    rows = df.collect()
    assert len({r.ingest_seq for r in rows}) == len(rows)
    return names, [[r[n] or "" for n in names] for r in sorted(rows, key=lambda r: (r.source_file, r.ingest_seq))]


def want(text):
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    return rows[0], [[c.replace("\r\n", "\n") for c in r] for r in rows[1:]]


def made(seed, n=120):
    rng = random.Random(seed)
    cells = ["plain", "a,b", "two\nlines", 'say "hi"', "", " spaced ", "one\n\n\nfour, and \"more\"\n", "x" * 60, '"', "\n", "é ₹ 日本"]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "first", "second"])
    for i in range(n):
        w.writerow([i, rng.choice(cells), rng.choice(cells)])
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2])
def test_line_breaks_across_splits(spark, tmp_path, small_splits, seed):
    text = made(seed)
    (tmp_path / "a.csv").write_text(text, newline="")
    assert read(spark, tmp_path / "a.csv") == want(text)


def test_several_files_and_line_ends(spark, tmp_path, small_splits):
    """One file with \\r\\n and blank lines, one without quotes, one whose quote marks stand inside plain fields."""
    texts = [made(3).replace("\n", "\r\n") + "\r\n\r\n", "id,first,second\n" + "".join(f"{i},b,c\n" for i in range(80)),
             'id,first,second\n1,5" pipe,x\n2,"two\nlines",6" pipe\n3,a "quoted" word,z\n']
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_text(t, newline="")
    names, rows = read(spark, tmp_path)
    assert rows == [r for t in texts for r in want(t)[1]]


def test_latin_1(spark, tmp_path, small_splits):
    text = "id,näme\n" + "".join(f'{i},"café\n№".replace\n'.replace("№", "ü") for i in range(40))
    (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
    names, rows = read(spark, tmp_path / "a.csv")
    assert names == ["id", "näme"] and [r[0] for r in rows] == [str(i) for i in range(40)] and all("café\nü" in r[1] for r in rows)


def test_unclosed_quote_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,ok\n2,"open\n3,more\n')
    assert [r[0] for r in read(spark, tmp_path / "a.csv")[1]] == ["1", "2"]
    (tmp_path / "b.csv").write_text("id,text\n")
    assert read(spark, tmp_path / "b.csv") == (["id", "text"], [])


def test_ingest_counts_records_not_lines(spark, tmp_path, small_splits):
    rows = ["settlement_id,date,amount,utr_reference,payer_account,fees_deducted,tax_deducted,net_amount,description,currency"]
    rows += [f'S{i},2026-07-0{1 + i % 9},Rs. 10.00,REF{i},A,0.00,,10.00,"first line\nsecond, line {i % 3}",INR' for i in range(30)]
    (tmp_path / "a.csv").write_text("\n".join([*rows, rows[1], rows[2].replace("10.00", "bad", 1)]) + "\n")
    done = ingest.ingest(ingest.read_csv(spark, str(tmp_path / "a.csv")), ingest.BANK)
    assert tuple(done.stats.first()) == (32, 30, 1, 1)
    assert {r.description for r in done.rows.collect()} == {f"first line\nsecond, line {k}" for k in range(3)}
