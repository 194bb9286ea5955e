"""Every query of the package that has SQL, against DuckDB on a small corpus
of hard rows: all scripts, nulls, empty, long and repeated texts, ties."""

import random

import duckdb
import pytest

from ledgerloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(77)
    words = [f"word{i}" for i in range(200)] + ["Жук", "ЁЖИК", "ΛΌΓΟΣ", "źdźbło", "ŻÓŁW", "ÉTÉ", "don't", "x", "7"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [text(rng.choice((1, 3, 6, 30, 90, 200))) + rng.choice(("", "\n\nsame line\nanother line", "\n \nsame line")) for _ in range(50)]
    passage, item = text(60), text(25)
    rows += [f"{text(20)} {passage} {text(40)}" for _ in range(4)] + [rows[7], rows[7].upper(), rows[8].lower(), f"{passage} {passage}", text(20_000)]
    near = rows[4].split()
    rows += [" ".join(near[:-2] + ["changed"]), f"{text(30)} {item}\n{text(9)} tiny ANSWER {text(3)}", "", "\n\n", "...", None, None, item.upper()]
    docs = list(enumerate(rows))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "tiny answer"), (3, text(40)), (4, None), (5, "!"), (6, "a b c d e f")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(k * 37, f"http://site{k}.example/{k}", f"<p>{text(5)}</p>" if k % 5 else "") for k in range(700)]
    pages.append((10**6, "http://site.example/long", "long " * 400_000))
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, folder, name):
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "pages"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = db.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        want = sorted(want.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, folder)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert set(df.columns) == set(columns)
    assert got == want and got
