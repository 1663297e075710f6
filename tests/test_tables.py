"""Columns, functions, groups, joins, pivots and limits over tables."""

import io
import math
import statistics

import pytest

from lathe.plans.spec import SpecError, load, split_line
from lathe.query import Builder, query
from lathe.sink import write_files, write_stream
from lathe.sources.files import Tabular, open_source

STOCK = """tea,S,3,1
tea,S,5,2
tea,M,4,9
rice,L,10,4
rice,S,2,2
rice,S,2,2
salt,M,7,-3
rice,L,6,1"""
A, B = [3, 5, 4, 10, 2, 2, 7, 6], [1, 2, 9, 4, 2, 2, -3, 1]
SIDES = "k1,N,north\nk2,E,east\nk3,S,south\nk4,W,west"
CARS = "Honda,R\nFord,B\nKia,Z"
CODES = "R,red,1\nB,black,2\nW,white,3"


@pytest.fixture
def table(spark):
    def make(text, names):
        rows = [(k, *line.split(",")) for k, line in enumerate(text.splitlines())]
        schema = "_ord long, " + ", ".join(f"`{n}` string" for n in names.split(","))
        return Tabular(spark.createDataFrame(rows, schema), ("_ord",))

    return make


@pytest.fixture
def csv(spark):
    def run(source, args, **options):
        out = io.StringIO()
        write_stream(query(spark, args, source, keep_order=True, **options), out)
        return out.getvalue().splitlines()[1:]

    return run


@pytest.mark.parametrize(
    "expr, value",
    [
        ("sum[a]", sum(A)),
        ("avg[a]", statistics.mean(A)),
        ("var[a]", statistics.variance(A)),
        ("stdev[a]", statistics.stdev(A)),
        ("cov[a,b]", statistics.covariance(A, B) * (len(A) - 1) / len(A)),
        ("corr[a,b]", statistics.correlation(A, B)),
        ("min[b]", min(B)),
        ("max[a]", max(A)),
        ("count[a]", "8"),
        ("sum[a]/count[a]", statistics.mean(A)),
        ('"$"&round[sum[a]/10,1]', "$3.9"),
        ("any[kind]", "tea"),
    ],
)
def test_aggregates(csv, table, expr, value):
    want = value if isinstance(value, str) else f"{value:.10f}".rstrip("0")
    assert csv(table(STOCK, "kind,size,a,b"), [expr]) == [want + "0" * want.endswith(".")]


def test_groups(csv, table):
    stock = table(STOCK, "kind,size,a,b")
    assert csv(stock, ["kind", "count[a]", "sum[a]", "avg[a]", "stdev[a]"]) == [
        "tea,3,12.0,4.0,1.0",
        "rice,4,20.0,5.0,3.829708431",
        "salt,1,7.0,7.0,0.0",
    ]
    assert csv(stock, ["kind", "n:count[a]", "sort[-n]", "top[1]"]) == ["rice,4"]
    assert csv(stock, ["kind", "n:count[a]", "where[count[a]>2]", "sort[-count[a]]"]) == ["rice,4", "tea,3"]
    # The limit comes before the filter on groups.
    assert csv(stock, ["kind", "n:count[a]", "where[count[a]<4]", "sort[-n]", "top[1]"]) == []
    assert csv(stock, ["sum[a]", "where[a>100]"]) == []
    assert csv(stock, ["size", "distinct[true]"]) == ["S", "M", "L"]
    assert csv(stock, ["kind", "size", "distinct[true]", "sort[size,-str[kind]]"])[:2] == ["rice,L", "tea,M"]
    single = table("x,1", "k,v")
    assert csv(single, ["k", "var[v]", "stdev[v]", "cov[v,v]", "corr[v,v]"]) == ["x,0.0,0.0,0.0,nan"]


@pytest.mark.parametrize(
    "expr, value",
    [
        ("a+b*c", "7.0"), ("c*b+a", "7.0"), ("c+a/b", "3.5"), ("[a+b]*c", "9.0"), ("b*b+c*c", "13.0"), ("3==a+b", "true"),
        ("b+b*c+c", "11.0"), ("a==1&&b==2", "true"), ("a&b==2&c", "false"), ("a&[b==2]&c", "1true3"), ("a-b+c", "2.0"),
        ("a/0", "nan"), ("int[a]/int[0]", "0"), ("int[7]/int[b]", "3"), ("-7%3", "-1"), ("7%0", "-1"), ("-a", "-1.0"),
        ("floor[-1.5]", "-2"), ("ceil[1.2]", "2"), ("round[-2.5]", "-3.0"), ("round[1234.567,2]", "1234.57"),
        ("round[1234.567,-2]", "1200.0"), ("abs[-3]", "3.0"), ("sqrt[4]", "2.0"), ("sqrt[-1]", "nan"), ("log[0]", "-inf"),
        ("log[-1]", "nan"), ("log[8,2]", "3.0"), ("pow[2,10]", "1024.0"), ("exp[0]", "1.0"), ("min[a,b]", "1"),
        ("max[b,10]", "10.0"), ('left["abc",2]', "ab"), ('left["abc",-2]', ""), ('right["abc",20]', "abc"),
        ('len["abc"]', "3"), ('upper["abc"]', "ABC"), ('lower["ABC"]', "abc"), ('contains["foo","o"]', "true"),
        ('contains["foo",""]', "false"), ('find["foo","o"]', "1"), ('find["foo",""]', "-1"), ('find["foo","x"]', "-1"),
        ("if[a==1,\"y\",\"n\"]", "y"), ("true^false", "true"), ("!true", "false"), ("true||false&&false", "true"),
        ('int["12abc"]', "12"), ('int["x"]', "0"), ('real[".5x"]', "0.5"), ('bool["0x"]', "false"), ('bool["x"]', "true"),
        ("str[2/3]", "0.666667"), ("str[2/3,2]", "0.67"), ("1000000*10&\"\"", "1e+07"), ("123456*1&\"\"", "123456"),
        ("type[1]", "real"), ("type[a]", "str"), ("type[a==b]", "bool"), ("type[int[a]]", "int"),
        ('datetime["17-6-8"]', "2017-06-08"), ('datetime["1999-12-31 23:59:59.5"]', "1999-12-31 23:59:59.5000"),
        ('datetime["99-1-1 1:02:03 pm"]', ""), ('datetime["99-1-1 1:02:03pm"]', "1999-01-01 13:02:03"),
        ('datetime["bad"]', ""), ('datetime[int[datetime["2017-06-08 10:00:00"]]+3600*24]', "2017-06-09 10:00:00"),
        ("formatsec[0]", "1970-01-01 00:00:00.000"), ("formatms[1500]", "1970-01-01 00:00:01.500"),
        ('datetime["2017-06-08"]<datetime["2017-06-08 00:00:01"]', "true"), ("x:1", "1.0"), ("'it''s'", None),
    ],
)
def test_expressions(csv, table, expr, value):
    source = table("1,2,3", "a,b,c")
    if value is None:
        with pytest.raises(SpecError):
            csv(source, [expr, "h:hidden[a]"])
    else:
        assert csv(source, [expr, "h:hidden[a]", "where[a==1]"]) == [value]


def test_untyped_comparisons(csv, table):
    source = table("01\n1\n10\n9\nx", "a")
    assert csv(source, ["a", "sort[a]"]) == ["01", "1", "10", "9", "x"]
    assert csv(source, ["a", "sort[-real[a],a]"]) == ["10", "9", "01", "1", "x"]
    assert csv(source, ["a", "sort[-str[a]]"]) == ["x", "9", "10", "1", "01"]
    assert csv(source, ["a", "where[a==1]"]) == ["01", "1"]
    assert csv(source, ["a", 'where[a=="1x"]']) == []


def test_limits(csv, table):
    numbers = table("\n".join(map(str, range(1, 21))), "num")
    assert csv(numbers, ["num", "where[num%2==0]", "first[5]"]) == ["2", "4"]
    assert csv(numbers, ["num", "where[num%2==0]", "top[3]"]) == ["2", "4", "6"]
    assert csv(numbers, ["num", "top[-1]"]) == []
    assert csv(numbers, ["rownum[]", "num", "where[num>18]"]) == ["1,19", "2,20"]


def test_aliases(csv, table):
    source = table("3,4", "a,b")
    assert csv(source, ["a:a+1", "c:a*10"]) == ["4.0,40.0"]
    assert csv(source, ["c:hyp*2", "hyp:hidden[sqrt[a*a+b*b]]"]) == ["10.0"]


def test_joins(csv, table):
    cars, codes = table(CARS, "make,code"), table(CODES, "id,name,n")
    tables = {"codes": codes}
    equal = "where[code==right::id]"
    assert csv(cars, ["make", "right::name", "join[codes]", equal], tables=tables) == ["Honda,red", "Ford,black"]
    assert csv(cars, ["make", "c::name", "c:join[codes,true]", "where[code==c::id]"], tables=tables) == [
        "Honda,red",
        "Ford,black",
        "Kia,",
    ]
    # Other filters see the empty values of rows without a partner.
    assert csv(cars, ["make", "right::name", "join[codes,true]", equal, 'where[right::name!="red"]'], tables=tables) == [
        "Ford,black",
        "Kia,",
    ]
    assert len(csv(cars, ["make", "right::name", "join[codes]"], tables=tables)) == 9
    assert len(csv(cars, ["make", "right::name", "join[codes]", "where[code!=right::id]"], tables=tables)) == 7
    assert csv(cars, ["sum[right::n]", "join[codes]", equal], tables=tables) == ["3.0"]
    assert csv(codes, ["id", "o::id", "o:join[codes]", "where[n<o::n]", "sort[id,o::id]"], tables=tables) == [
        "B,W",
        "R,B",
        "R,W",
    ]


def test_pivots(csv, table):
    sides = table(SIDES, "key,side,word")
    assert csv(sides, ["key", "...:pivot[side,word]"]) == ["k4,north,east,south,west"]
    assert csv(sides, ["S,...,E:pivot[side,word]"]) == ["south,north,west,east"]
    events = table("1,a,x\n1,b,y\n2,a,z\n1,a,w", "user,kind,value")
    assert csv(events, ["user", "a,b:pivot[kind,value]"], partition=["user"]) == ["1,w,y", "2,z,"]


def test_builder_and_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.5, True), (2, 3.5, False)], "n long, x double, ok boolean")
    rows = Builder(spark, df).column("n").column("x*2", "twice").where("ok").frame().collect()
    assert [tuple(r) for r in rows] == [(1, 5.0)]
    total = Builder(spark, df).column("sum[n]", "total").column("any[ok]", "some").frame().collect()[0]
    assert total["total"] == 3
    nested = spark.sql("select named_struct('b', 7) a")
    assert query(spark, ["a.b"], nested).collect()[0][0] == 7
    assert math.isnan(query(spark, ["x/0"], df).collect()[0][0])


@pytest.mark.parametrize(
    "args, message",
    [
        ([""], "Missing expression"),
        (["foo[a]"], "Unrecognized function: foo"),
        (["len[a,b]"], "Wrong number of arguments for len"),
        (["x:a", "x:b"], "Duplicate column name: x"),
        (["a", "a"], "Duplicate column: a"),
        (["p:q", "q:p"], "Circular column reference"),
        (["sum[max[a]]"], "Aggregate functions cannot be composed"),
        (["sum[a]+b"], "both aggregates and non-aggregates"),
        (["right::a"], "Can't reference joined paths without a join directive"),
        (["zip::a"], "Unknown scope name: zip"),
        (["a+where[b]"], "Top-level expression only: where"),
        (["a", "top[1]", "top[2]"], "Expression can only be used once: top"),
        (["+a"], "Infix positive operator not supported"),
        (["{a"], 'Expected "}", got "end of argument"'),
        (["[a"], 'Expected "]"'),
        (["len[a"], 'Expected "," or "]"'),
        (["a,b:len[a]"], "Multiple column names only valid for pivot function"),
        (["...:len[a]"], "Column name spread (...) only valid for pivot function"),
        (["a,b,:pivot[a,b]"], "Expected a column name after comma"),
        (["x:pivot[sum[a],b]"], "Pivot names argument must not contain aggregate functions"),
        (["1", "sort[1]"], "Sorts require least one input path reference"),
        (["1", "distinct[true]"], "Use of distinct requires least one input path reference"),
        (["9t"], 'Expected "end of argument", got "t"'),
        (["--"], 'Expected "identifier", got "end of argument"'),
        (["pivot[a"], 'Expected "," or "]", got "end of argument"'),
        (["a*.b"], 'Unexpected "."'),
        (["min[a,"], "Missing expression"),
        (["a1:a3", "a2:a1", "a3:a2"], "Circular column reference: a3"),
        (["depth[1]"], "First argument must be a path reference"),
        (["pivot[a,b]"], "Pivot function requires column names, which can include spread (...)"),
        (["a b)"], 'Expected "end of argument", got ")"'),
    ],
)
def test_errors(spark, args, message):
    with pytest.raises(SpecError) as error:
        query(spark, args, spark.range(1).selectExpr("id a", "id b", "id c"))
    assert message in str(error.value)


def test_argument_files(tmp_path):
    (tmp_path / "inner").write_text("c # comment\n")
    (tmp_path / "outer").write_text("# head\na+b  x:max[a, b]\n\"#\" @inner\n")
    assert [s.text for s in load(["@outer", "d"], str(tmp_path))] == ["a+b", "x:max[a, b]", '"#"', "c", "d"]
    assert split_line('a "b c" max[a, b] {x y} # no') == ["a", '"b c"', "max[a, b]", "{x y}"]
    with pytest.raises(SpecError, match="could not be opened"):
        load(["@none"], str(tmp_path))


def test_delimited_files(spark, csv, tmp_path):
    path = tmp_path / "jagged.csv"
    path.write_text('p,q\n11,12\n13,\n14\n15,16,17\n"x ""y"", z","u\nv"\n')
    source = open_source(spark, str(path))
    assert [c for c in source.df.columns if c != "_ord"] == ["p", "q", "3"]
    out = io.StringIO()
    write_stream(query(spark, ["p", "q", "{3}"], source, keep_order=True), out)
    assert out.getvalue() == 'p,q,{3}\n11,12,\n13,,\n14,,\n15,16,17\n"x ""y"", z","u\nv",\n'
    path.write_text('p,q\n1,"x,y,z"\n2,"a,b,c,d"\n')
    # Separators within quotes make no columns.
    assert [c for c in open_source(spark, str(path)).df.columns if c != "_ord"] == ["p", "q"]
    path.write_text('p,q\n1,"x,y,z",3\n')
    assert csv(open_source(spark, str(path)), ["q", "{3}"]) == ['"x,y,z",3']
    path = tmp_path / "plain.tsv"
    path.write_bytes(b"1\t2\r\n3\t4\r\n")
    assert csv(open_source(spark, str(path), header=False), ["{1}", "{2}"]) == ["1,2", "3,4"]
    for name, text, kind in (
        ("x", "<a><b>1</b></a>", "xml"),
        ("j", '[{"b": 1}]', "json"),
        ("l", "[17-06-08 21:18:07.01] [INFO] cat - b: {b: 1}", "log"),
    ):
        (tmp_path / name).write_text(text)
        found = open_source(spark, str(tmp_path / name))
        assert found.kind == kind and csv(found, ["b"]) == ["1"]
    with pytest.raises(SpecError, match="could not be opened"):
        open_source(spark, str(tmp_path / "none"))


def test_unequal_records_go_through_the_matcher(spark, csv, tmp_path):
    path = tmp_path / "jagged.csv"
    path.write_text("p,q\n11,12\n13\n14,15,16\n17,\n18,,19\n")
    source = open_source(spark, str(path), records=False)
    # Records are padded to the widest before them: the second is not, so its row is complete only with the third.
    assert csv(source, ["p", "q", "{3}"]) == ["11,12,16", "17,,", "18,,19"]
    assert csv(source, ["p", "q", "{3}", "sync[row]"]) == ["11,12,", "13,,", "14,15,16", "17,,", "18,,19"]


def test_files_and_echo(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a,b")], "n long, x double, s string").coalesce(1)
    write_files(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == 'n,x,s\n1,0.5,"a,b"\n'
    assert "<n>1</n>" in query(spark, ["where[true]"], df).collect()[0][0]


def test_command_line(spark, tmp_path, capsys):
    from lathe.cli import main

    path = tmp_path / "in.csv"
    path.write_text("k,v\na,1\nb,2\na,3\n")
    out = io.StringIO()
    assert main([f"in[{path}]", "k", "sum[v]"], out) == 0
    assert out.getvalue() == "k,sum[v]\na,4.0\nb,2.0\n"
    out = io.StringIO()
    assert main([f"in[{path}]", "k", "where[v>1]", "outheader[false]"], out) == 0
    assert out.getvalue() == "b\na\n"
    path.write_text("<a><b>1</b></a>")
    assert main([f"in[{path}]", "b", "zzz"], out) == 255
    assert "Path not matched in input: zzz" in capsys.readouterr().err
    assert main(["--help"], out) == 0
    assert main(["nope["], out) == 255 and capsys.readouterr().err


def test_streaming(spark, tmp_path):
    from lathe.streaming import stream_query

    spark.range(10).selectExpr("id n", "id % 2 k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, k long").parquet(str(tmp_path / "in"))
    for text, expected in (("n where[n>7]", [(8,), (9,)]), ("k sum[n] sort[k]", [(0, 20), (1, 25)])):
        df, mode = stream_query(spark, text, stream)
        run = df.writeStream.outputMode(mode).format("memory").queryName("found").start()
        run.processAllAvailable()
        run.stop()
        assert sorted(tuple(r) for r in spark.table("found").collect()) == expected
    with pytest.raises(SpecError):
        stream_query(spark, "n top[1]", stream)


def test_numbering_at_scale(spark):
    from pyspark.sql import functions as F

    from lathe.operators.numbering import number_rows

    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("v")).repartition(7)
    got = number_rows(df, [F.col("v")], "k").collect()
    assert len(got) == 1000 and all(r["v"] == r["k"] for r in got)
