"""Loading: encodings, separators, headers, tidying, workbooks."""

import csv
import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens import LoadError, list_sheets, load_table
from tablelens.sources import tidy as td
from tablelens.sources.delimited import charset_session, header_names, layout, read_delimited
from tablelens.sources.records import _states, decoded_lines, records

REGIONS = ["서울", "부산", "대구", "광주"] * 30
AMOUNTS = [1000 + 37 * i for i in range(120)]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_utf8_with_mark_and_semicolons(spark, tmp_path):
    text = "지역;금액\n" + "\n".join(f"{r};{a}" for r, a in zip(REGIONS, AMOUNTS))
    got = load_table(spark, write(tmp_path / "semi.csv", text, "utf-8-sig"))
    assert got.df.columns == ["지역", "금액"] and got.separator == ";" and got.encoding == "utf-8-sig"
    assert rows(got.df) == sorted(zip(REGIONS, AMOUNTS))


def test_cp949_keeps_extended_letters(spark, tmp_path):
    text = "지역,금액\n" + "\n".join(f"{r},{a}" for r, a in zip(REGIONS, AMOUNTS)) + "\n똠방각하,5\n"
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = load_table(spark, write(tmp_path / "cp949.csv", text, "cp949"))
    assert got.encoding == "cp949" and got.df.columns == ["지역", "금액"]
    assert ("똠방각하", 5) in rows(got.df) and got.n_rows == 121
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
    assert got.df.sparkSession is spark or got.df.join(spark.range(1).select(F.lit(5).alias("금액")), "금액").count() == 1


def test_latin1_is_the_last_resort(spark, tmp_path):
    got = load_table(spark, write(tmp_path / "l.csv", "name,x\nJos\xe9\xff,1\nA,2\n", "latin1"))
    assert got.encoding in ("cp949", "latin1") and got.n_rows == 2


def test_tokens_types_quotes_and_lines_in_quotes(spark, tmp_path):
    text = 'a,b,c,d,e\n1,1.5,x,True,"one, ""two"""\nNA,,n/a,False,"first\nsecond"\n3,2,y,true,z\n'
    got = load_table(spark, write(tmp_path / "t.csv", text))
    assert [t for _, t in got.df.dtypes] == ["bigint", "double", "string", "boolean", "string"]
    assert (3, 2.0, "y", True, "z") in [tuple(r) for r in got.df.collect()]
    assert {r["e"] for r in got.df.collect()} == {'one, "two"', "first\nsecond", "z"}
    assert got.df.where("a IS NULL AND b IS NULL AND c IS NULL").count() == 1


def cells(rng):
    return "".join(rng.choice(["a", "b", '"', ",", "\n", "\r\n", " ", "é", '""', "x\n\n\ny"]) for _ in range(rng.randint(0, 8)))


@pytest.mark.parametrize("split, encoding", [("400", "utf-8"), ("1500", "cp949"), ("1m", "utf-8")])
def test_every_split_finds_its_own_records(spark, tmp_path, split, encoding):
    rng = random.Random(split)
    rows = [["id", "te\nxt", "c"], *([str(i), cells(rng).replace("é", "가"), cells(rng).replace("é", "나")] for i in range(60)), ["60", "long\n" * 150, '"']]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    (tmp_path / "m").mkdir()
    for i in range(2):
        write(tmp_path / "m" / f"{i}.csv", "\r\n\r\n" * i + out.getvalue() + "\n", encoding)
    session = charset_session(spark) if encoding != "utf-8" else spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", split)
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    found = records(session, str(tmp_path / "m"), "MS949" if encoding == "cp949" else "UTF-8", ",").collect()
    got = [next(csv.reader(io.StringIO(r.record, newline=""))) for r in found if not r.header]
    assert sorted(got) == sorted(rows[1:] * 2) and [r.record for r in found if r.header] == ['id,"te\nxt",c'] * 2
    loaded, _, separator, _ = read_delimited(session, str(tmp_path / "m"))
    assert loaded.columns == rows[0] and separator == ","
    want = [(int(i), *(x if x.strip(" ") else None for x in (a, b))) for i, a, b in rows[1:]] * 2
    assert sorted(map(str, map(tuple, loaded.collect()))) == sorted(map(str, want))


def test_many_small_splits_take_few_tasks(spark, tmp_path):
    rows = "".join(f'{i},"a\n""b"" {i}"\n' for i in range(3_000))
    path = write(tmp_path / "s.csv", "id,text\n" + rows)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "512")
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    lines = decoded_lines(session, path, "UTF-8")
    n_splits = lines.select("start").distinct().count()
    assert n_splits > 80 and lines.rdd.getNumPartitions() == 16  # four for each slot
    got = load_table(session, path).df
    assert got.rdd.getNumPartitions() <= 16
    assert sorted(map(tuple, got.collect())) == [(i, f'a\n"b" {i}') for i in range(3_000)]


def test_records_wider_than_the_header_and_a_quote_without_end(spark, tmp_path):
    got = load_table(spark, write(tmp_path / "w.csv", 'a,b\n1,"x\ny",more\n\n2,"z\n'))
    assert sorted(map(str, map(tuple, got.df.collect()))) == sorted(map(str, [(1, "x\ny", "more"), (2, "z", None)]))
    assert any("more fields" in n for n in got.notes)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans())), st.booleans())
def test_states_of_lines_follow_each_other(maps, inside):
    opens, stays = (np.array([m[k] for m in maps], bool) for k in (0, 1))
    want = [inside]
    for out, in_ in maps:
        want.append(in_ if want[-1] else out)
    assert _states(opens, stays, inside).tolist() == want


def test_product_codes_are_not_numbers(spark, tmp_path):
    got = load_table(spark, write(tmp_path / "c.csv", "code,x\n3D,1\n1d,2\n1f,3\n"))
    assert got.df.dtypes[0] == ("code", "string")


def test_headers(spark, tmp_path):
    assert header_names("a,a,,b.c", ",") == ["a", "a.1", "Unnamed: 2", "b.c"]
    got = load_table(spark, write(tmp_path / "h.csv", " a ,a,a.x,\n1,2,3,\n4,5,6,\n"))
    assert got.df.columns == ["a", "a_1", "a.x"]
    assert got.n_rows == 2 and any("tidied" in n for n in got.notes)


def test_unique_names_never_collide():
    assert td.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_1", "a_1_1", "a_2"]
    assert len(set(td.unique_names(["a", "a", "a_1", "a_1", "a"]))) == 5


def test_single_column_and_separator_choice(spark, tmp_path):
    def of(*lines):
        return layout(spark.createDataFrame([(x,) for x in lines], "line string"), lines[0])
    assert of("a|b", "1|2,3", "4|5") == ("|", 2, 0, False)
    assert of("only", "1", "2")[0] is None
    assert of("a,b", '1,5"', '2,"x,y"', "3,4,5", "") == (",", 3, 1, False)
    assert of("a,b", '1,"open', 'end"')[3]
    got = load_table(spark, write(tmp_path / "one.csv", "only\n1\n2\n"))
    assert got.df.columns == ["only"] and got.n_rows == 2


def test_tidy_drops_empty_parts_and_junk(spark):
    df = spark.createDataFrame(
        [(1, None, None, "x", None)] * 12 + [(None, None, None, None, None), (2, None, "left", "y", None)],
        "` a ` int, empty string, `Unnamed: 0` string, a string, nan double").withColumn("nan", F.lit(float("nan")))
    got = td.tidy(df, "t")
    assert got.df.columns == ["a", "a_1"] and got.n_rows == 13
    assert any("nearly empty" in n for n in got.notes)
    capped = td.tidy(df, "t", max_rows=5, order_by=["a"])
    assert capped.df.count() == 5 and capped.n_rows == 5


def test_errors(spark, tmp_path):
    with pytest.raises(LoadError):
        load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(LoadError):
        load_table(spark, str(tmp_path / "none.xlsx"))
    with pytest.raises(LoadError):
        load_table(spark, write(tmp_path / "x.pdf", "x"))
    with pytest.raises(LoadError):
        load_table(spark, write(tmp_path / "empty.csv", "a,b\n,\n,\n"))
    with pytest.raises(LoadError):
        load_table(spark, write(tmp_path / "nothing.csv", ""))


# -- workbooks -------------------------------------------------------------------------------------------
def cell_xml(ref, value):
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    if value is None:
        return ""
    style = ' s="1"' if isinstance(value, tuple) else ""
    return f'<c r="{ref}"{style}><v>{value[0] if style else value}</v></c>'


def write_workbook(path, sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, table in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell_xml(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(table, 1))
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return str(path)


def test_workbook(spark, tmp_path):
    table = [["지역", "금액", "일자"], ["서울", 1, (45292,)], ["부산", 2.5, (45293,)], [None, None, None], ["대구", None, (45294,)]]
    path = write_workbook(tmp_path / "data.xlsx", {"first": table, "second": [["x"], [1], [2]]})
    assert [r["sheet"] for r in list_sheets(spark, path).orderBy("sheet_no").collect()] == ["first", "second"]
    got = load_table(spark, path)
    assert got.df.columns == ["지역", "금액", "일자"] and got.n_rows == 3 and got.sheet_name == "first"
    assert ("서울", 1.0, "2024-01-01 00:00:00") in [tuple(r) for r in got.df.collect()]
    other = load_table(spark, path, sheet_name="second")
    assert rows(other.df) == [(1,), (2,)]
    with pytest.raises(LoadError):
        load_table(spark, path, sheet_name="third")


def test_many_workbooks_align_by_name(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"s": [["x", "y"], [1, "p"]]})
    write_workbook(tmp_path / "b.xlsx", {"s": [["y", "z"], ["q", 5]]})
    got = load_table(spark, str(tmp_path / "*.xlsx"))
    assert got.df.columns == ["x", "y", "z"]
    assert sorted(map(str, rows(got.df.select(F.coalesce("x", F.lit(-1)), "y", F.coalesce("z", F.lit(-1)))))) == [
        "(-1, 'q', 5)", "(1, 'p', -1)"]


def test_native_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    df.write.parquet(str(tmp_path / "d.parquet"))
    got = load_table(spark, str(tmp_path / "d.parquet"))
    assert got.n_rows == 2 and got.meta(spark).first()["n_cols"] == 2
    assert got.meta_dict()["source"] == "d.parquet"
