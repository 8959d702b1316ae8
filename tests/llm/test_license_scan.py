import textwrap

import duckdb

from reportloom.llm import license_scan as ls


def test_variants_of_a_licence_are_found_and_sql_agrees(spark, tmp_path):
    mit = " ".join(ls.KNOWN["MIT"].split())
    rows = [
        (1, mit), (2, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper()), (3, mit.replace("sublicense", "sub-licence") + " "),
        (4, mit + " extra"), (5, None), (6, ""), (None, "Released under the MIT Licence"), (7, "© me\n(c) you"), (1, mit), (8, "x_y " * 9000),
    ]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string").write.parquet(path)
    got = ls.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got if r.license) == [(0, "MIT notice"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT")]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(db.sql(ls.SQL).fetchall(), key=str)
    assert ls.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_titled_and_rewrapped_copies(spark, tmp_path):
    wrap = lambda text, n: "\n".join(textwrap.wrap(" ".join(text.split()), n))
    names = [*ls.TITLES]
    rows = [(k, ls.TITLES[n][0] + "\n\nCopyright (c) 2020 A. Person\n\n" + ls.KNOWN[n]) for k, n in enumerate(names) if n not in ls.FILES]
    rows += [(k, ls.KNOWN[n]) for k, n in enumerate(names) if n in ls.FILES]
    rows += [(100 + n, wrap(ls.KNOWN["MIT"], n)) for n in range(40, 100)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.license for r in ls.query(spark, str(tmp_path)).collect()}
    assert got == {k: "MIT" if k >= 100 else names[k] for k, _ in rows}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"} <= set(names)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert {r[0]: r[3] for r in db.sql(ls.SQL).fetchall()} == got
