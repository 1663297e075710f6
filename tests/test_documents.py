"""Row formation from XML, relaxed JSON and logs."""

import io
import tracemalloc

import duckdb
import pytest

from lathe.plans import catalog, file_catalog
from lathe.plans.spec import SpecError
from lathe.query import query
from lathe.sink import write_stream
from lathe.sources.files import Documents
from lathe.sources.tree import Matcher, Wanted, embedded_json, json_events, log_events, log_line

FLEET = """<fleet base="Oslo">
  <ship><name>Aud</name>
    <deck no="1"><cabin berth="a"><name>c1</name></cabin><cabin><name>c2</name></cabin></deck>
    <hold><rack no="5"><bin><name>b1</name></bin></rack></hold></ship>
  <ship base="Bergen"><name>Liv</name></ship>
</fleet>"""
HOUSE = """<house><floor><room><lamp>l1</lamp></room><lamp>l2</lamp></floor>
<floor/><floor><room><desk><lamp>l3</lamp></desk></room></floor></house>"""
DAY = """<day><client>Ana</client><item>3</item><item>4</item><client>Ben</client><cart><item>10</item></cart>
<visit><client>Cyd</client><cart><item>100</item><item>200</item></cart></visit><visit><client>Dov</client></visit>
<box><item>7</item></box></day>"""
REPLIES = """<all><person><name>Eli</name><reply><q2>no</q2><q1>yes</q1></reply><reply><q3>5</q3></reply></person>
<person><name>Fay</name><reply><q1>no</q1><q3>2</q3></reply></person></all>"""
NOTES = """{ 'id': 1, colour: red, "tags": ["p", "q",], grid: [[5, 6], [7]], parts: [{w: 1, h: 2}, {w: 3 h: 4}] }
{"id": 2 'colour': "blue"}"""
SHOP_LOG = """[2024-03-01 08:00:00.5] [INFO] shop - sale of tea cart: { item: { code: [4, 9] }, till: "east" } done
[2024-03-01 08:00:01.5] [WARN] shop - drawer open
for a minute
[2024-03-01 08:00:02.5] [INFO] { item: { code: [7] }, till: "west" } closed
"""
JOBS = """[2024-03-01 09:00:00.1] [TRACE] START - job: { id: 5 } begins
[2024-03-01 09:00:00.2] [TRACE] START - step: { part: 6 } loads
[2024-03-01 09:00:00.3] [TRACE] END - step ends
[2024-03-01 09:00:00.4] [TRACE] ROOT - all ends
"""
SHOPS = """<shops><shop><stock><tea>4</tea><rice>5</rice></stock><stock><tea>6</tea></stock></shop>
<shop><stock><salt>70</salt></stock><stock><rice>80</rice></stock></shop></shops>"""


@pytest.fixture
def csv(spark):
    def run(text, kind, args):
        docs = spark.createDataFrame([(0, text)], "doc long, text string")
        out = io.StringIO()
        write_stream(query(spark, args, Documents(docs, kind), keep_order=True), out)
        return out.getvalue().splitlines()[1:]

    return run


@pytest.mark.parametrize(
    "path, rows",
    [
        ("ship.*.name", "Aud c1 c2 b1 Liv"),
        ("ship.*.*.name", "c1 c2 b1"),
        ("ship.*.*.*.name", "c1 c2 b1"),
        ("ship.*.*.*.*.name", "b1"),
        ("*.name", "Aud c1 c2 b1 Liv"),
        ("*.ship.name", "Aud Liv"),
        ("*.deck.*.name", "c1 c2"),
        ("SHIP.deck.Cabin.name", "c1 c2"),
    ],
)
def test_wildcards(csv, path, rows):
    assert csv(FLEET, "xml", [path]) == rows.split()


def test_case(csv):
    assert csv(FLEET, "xml", ["case[true]", "SHIP.name"]) == []


def test_attributes_are_inherited(csv):
    assert csv(FLEET, "xml", ["name", "name..base", "name..no"]) == [
        "Aud,Oslo,",
        "c1,Oslo,1",
        "c2,Oslo,1",
        "b1,Oslo,5",
        "Liv,Bergen,",
    ]


def test_outer_values_are_carried_down(csv):
    assert csv(DAY, "xml", ["client", "int[sum[item]]"]) == ["Ana,7", "Ben,10", "Cyd,300", "Dov,7"]


def test_structure(csv):
    facts = ["path[lamp]", "depth[lamp]", "nodename[lamp,1]", "nodenum[lamp]", "nodenum[lamp,1]", "nodenum[lamp,floor]"]
    assert csv(HOUSE, "xml", ["lamp", *facts]) == [
        "l1,house.floor.room,3,room,4,3,2",
        "l2,house.floor,2,floor,5,2,2",
        "l3,house.floor.room.desk,4,desk,10,9,7",
    ]
    assert csv(HOUSE, "xml", ["nodestart[floor]", "nodeend[floor]", "size:[nodeend[floor]-nodestart[floor]]"]) == [
        "2,5,3",
        "6,6,0",
        "7,10,3",
    ]
    assert csv(HOUSE, "xml", ["parent[lamp]", "lamp"]) == ["room,l1", "floor,l2", "desk,l3"]
    assert csv(HOUSE, "xml", ["pivotpath[lamp]", "lamp", 'where[lamp=="l3"]']) == [
        "house.floor.room.desk,l3", "floor.room.desk,l3", "room.desk,l3", "desk,l3",
    ]
    assert csv(HOUSE, "xml", ["lamp", "root[7]"]) == ["l3"]
    assert csv(HOUSE, "xml", ["lamp", "root[2]"]) == ["l1", "l2"]
    assert csv(HOUSE, "xml", ["rownum[]", "lamp", 'where[lamp!="l1"]']) == ["1,l2", "2,l3"]
    assert csv("<p>\n\n<u>1</u>\n<v>2</v></p>", "xml", ["u", "linenum[u]", "v", "linenum[v]"]) == ["1,3,2,4"]


def test_sync(csv):
    assert csv(REPLIES, "xml", ["name", "q1", "q2", "q3", "sync[reply]"]) == ["Eli,yes,no,", "Eli,,,5", "Fay,no,,2"]


def test_markup_and_entities(csv):
    assert csv("<t><a>x<i>y</i>z</a></t>", "xml", ["a"]) == ["x<i>y</i>z"]
    assert csv("<t><!-- no --><a>x &lt; &amp; y</a><a/></t>", "xml", ["a"]) == ["x < & y", ""]
    assert csv("<r><a>8</a></r><r><a>9</a></r>", "xml", ["a"]) == ["8", "9"]


def test_entities_end_with_semicolons(csv):
    assert csv("<t><a>x &amp y &copy &quot;&#65;&#x42;&#228; &no; &#0;</a></t>", "xml", ["a"]) == ['"x &amp y &copy ""ABä &no; &#0;"']


def test_relaxed_json(csv):
    assert csv(NOTES, "json", ["id", "colour"]) == ["1,red", "2,blue"]
    assert csv(NOTES, "json", ["tags"]) == ["p", "q"]
    assert csv(NOTES, "json", ["w", "h"]) == ["1,2", "3,4"]
    assert csv('[[{"w": 1, "h": 2}], [{"w": 3, "h": 4}]]', "json", ["row.*.w", "row.*.h"]) == ["1,2", "3,4"]
    assert csv('[[{"w": 1, "h": 2}], [{"w": 3, "h": 4}]]', "json", ["row.*.*"]) == ["1", "2", "3", "4"]
    assert csv('{"no": "Norway", "se": "Sweden"}', "json", ["nodename[json.*]", "json.*"]) == ["no,Norway", "se,Sweden"]
    assert csv('{"o": {"_attr": {"unit": "kg"}, "m": "3"}}', "json", ["m", "m..unit"]) == ["3,kg"]


def test_echo(spark):
    """Without columns, a document comes out as XML."""
    docs = lambda text, kind: Documents(spark.createDataFrame([(0, text)], "doc long, text string"), kind)
    shown = lambda text, kind: query(spark, [], docs(text, kind)).collect()[0][0].splitlines()
    assert shown("{n: 1, list: [2, 3], deep: [[4, '<']], in: {x: 5}}", "json") == [
        "<json>", "  <n>1</n>", "  <list>2</list>", "  <list>3</list>", "  <deep>", "    <0>4</0>", "    <0>&lt;</0>", "  </deep>",
        "  <in>", "    <x>5</x>", "  </in>", "</json>",
    ]
    assert shown("<a><b>1</b></a>", "xml") == ["<a><b>1</b></a>"]
    assert shown("2024-03-01 08:00:00 INFO shop - open", "log") == [
        "<log>", "  <row>", "    <time>2024-03-01 08:00:00</time>", "    <level>INFO</level>", "    <category>shop</category>",
        "    <msg>open</msg>", "  </row>", "</log>",
    ]


def test_documents_one_after_another(spark):
    """A task's documents share a matcher and batches, but nothing of one is seen in another."""
    rows = [(k, f"<t><a>{k}</a><b>{k}</b></t>" if k % 3 else f"<t><a>{k}</a></t>") for k in range(50)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    found = query(spark, ["a", "b"], Documents(docs, "xml")).collect()
    assert sorted((r[0], r[1]) for r in found) == sorted((str(k), str(k)) for k in range(50) if k % 3)


def test_log(csv):
    assert log_line("2017-06-08 21:18:07,1 x") is None
    assert embedded_json("cart: {x: {y: 1}} paid") == ("{x: {y: 1}}", "cart: paid")
    assert csv(SHOP_LOG, "log", ["time", "level", "category"]) == [
        "2024-03-01 08:00:00.5,INFO,shop",
        "2024-03-01 08:00:01.5,WARN,shop",
        "2024-03-01 08:00:02.5,INFO,",
    ]
    assert csv(SHOP_LOG, "log", ["code", "till"]) == ["4,east", "7,west"]
    assert csv(SHOP_LOG, "log", ["level", "n:count[msg]", "sort[level]"]) == ["INFO,2", "WARN,1"]
    assert csv(JOBS, "log", ["id", "part"]) == ["5,6"]


def test_pivot(csv):
    pairs = "pivot[nodename[stock.*],stock.*"
    assert csv(SHOPS, "xml", [f"...:{pairs}]"]) == ["4,5", "6,", ",", ",80"]
    assert csv(SHOPS, "xml", [f"...:{pairs},true]"]) == ["4,5,", "6,,", ",,70", ",80,"]
    assert csv(SHOPS, "xml", [f"rice,tea:{pairs}]"]) == ["5,4", ",6", ",", "80,"]
    assert csv(SHOPS, "xml", [f"tea:{pairs}]", "sum[tea]"]) == ["10.0"]


def test_rejected_partitions_bring_no_columns(csv):
    pairs = "pivot[nodename[stock.*],stock.*"
    assert csv(SHOPS, "xml", [f"tea,...:{pairs},true]", "where[tea!='']"]) == ["4,5", "6,"]
    # A spread takes its columns from the first partition that the filters accept.
    assert csv(SHOPS, "xml", [f"tea,...:{pairs}]", "where[tea=='']"]) == [",70", ","]
    with pytest.raises(SpecError, match="Pivot columns not found in input: oats"):
        csv(SHOPS, "xml", [f"oats,...:{pairs},true]"])


def test_bad_tag(csv):
    with pytest.raises(Exception, match="Invalid XML tag"):
        csv("<a><b", "xml", ["a"])


def test_unknown_path_in_table(spark):
    with pytest.raises(SpecError, match="Path not matched in input: zzz"):
        query(spark, ["zzz"], spark.range(1).toDF("a"))


def _peak(kind, text, *paths):
    """Rows of a text, and the most bytes that were held for them beyond the text."""
    tracemalloc.start()
    count = sum(1 for _ in Matcher(Wanted(tuple((p,) for p in paths))).rows(kind(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return count, peak


@pytest.mark.parametrize("form", ["{}", "[{}]", '{{"all": [{}]}}'])
@pytest.mark.parametrize("own", ["", '"_attr": {"unit": "kg"}, '])
def test_json_is_read_as_it_goes(form, own):
    """One line after another, an array, and an array within an object; each with attributes, which are looked for ahead."""
    if own and form.startswith("{{"):
        pytest.skip("an object that may have attributes at its end is looked through as a whole")
    text = form.format("\n".join(f'{{{own}"k": {k}, "in": {{"x": [1, 2]}}}}' for k in range(10_000)))
    assert text.count('"k"') == 10_000
    count, peak = _peak(json_events, text, "k")
    assert count == 10_000 and peak < 600_000


def test_attributes_behind_their_object(csv):
    assert csv('{"o": {"m": "3", "_attr": {"unit": "kg"}}}{"o": {"m": 4}}', "json", ["m", "m..unit"]) == ["3,kg", "4,"]


def test_log_is_read_as_it_goes():
    line = "[2024-03-01 08:00:00.5] [INFO] shop - sale of tea {{code: {0}}}\nand more\n"
    count, peak = _peak(log_events, "".join(line.format(k) for k in range(10_000)), "code")
    assert count == 10_000 and peak < 600_000


def test_elements_of_an_entry_are_one_event_each():
    """Events of a log cost most of its reading: 19 for this entry with a start, a text and an end for each element."""
    found = list(log_events("[2024-03-01 08:00:00.5] [INFO] shop - sale of tea {code: 4}"))
    assert [e[:2] for e in found] == [
        ("start", "log"), ("start", "row"), ("leaf", "time"), ("leaf", "level"), ("leaf", "category"), ("leaf", "code"), ("leaf", "msg"),
        ("end", "row"), ("end", "log"),
    ]


@pytest.mark.parametrize("name", ["json_file", "log_trace_scopes", "log_file"])
def test_documents_have_a_bounded_length(spark, tmp_path, monkeypatch, name):
    """A task's rows go to several documents, with the same rows as one."""
    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(file_catalog, "RECORDS", 70)
    write = file_catalog.FILES[name][0]
    write(spark, small, f"{tmp_path}/files")
    parts = list((tmp_path / "files").glob("part-*"))
    records = spark.read.parquet(f"{small}/events.parquet").count()
    assert len(parts) >= records / 70 > 1
    df = catalog.queries()[name](spark, small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_documents_of_a_table_are_dealt_out(spark, tmp_path):
    """A table in one file is scanned by one task, but its documents are read by several."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.queries()["log_parse"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
