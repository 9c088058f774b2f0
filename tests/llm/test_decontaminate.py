import re

from strandlake.llm import decontaminate as D

from .conftest import COLUMNS, rows

ITEM = "A train leaves Boston at 60 km per hour and another leaves Denver at 80 km per hour; after how many hours do they meet if Boston is 700 km away"
TEXTS = [
    (1, "Intro words first. " + ITEM + " and so on we go.", "en", "x"), (2, "Well: " + ITEM.replace("60", "45").replace("80", "95").replace("Boston", "Paris").replace("Denver", "Lyon"), "en", "x"),
    (3, "hm: " + ITEM.replace("at 60", "at 45").replace("if Boston", "if Chicago"), "en", "x"), (4, "nothing of the kind is in here, only other words about trains and hours", "en", "x"), (5, None, "en", "x"), (6, "", "en", None),
    (7, ITEM.upper(), "en", "x"), (8, ITEM.lower(), "en", "x"), (None, ITEM, "en", "x"), (9, ITEM, "en", "x"), (9, ITEM, "en", "x"), (10, "a train leaves " * 3000, "en", "x"), (11, ("One two. " * 20000) + ITEM, "en", "x"), (12, "they say six words make it", "en", "x"),
]
ITEMS = [(100, ITEM), (101, None), (102, ""), (103, "too short it"), (None, ITEM), (104, "six words make it whole here"), (105, "1 2 3 4 5 6 7 8 9 10")]


def found(spark, docs):
    items = spark.createDataFrame([(*i, "t", "r") for i in ITEMS], "item_id long, text string, row string, words string")
    return D.matches(docs, items)


def test_slots_and_edges(spark, nothing):
    docs = spark.createDataFrame(rows(TEXTS), COLUMNS)
    got = {(r.doc_id, r.item_id): r for r in found(spark, docs).collect()}
    assert {k for k in got if k[1] == 100} == {(i, 100) for i in (1, 2, 3, 7, 8, 9, 11, None)}  # 3 holds 20 words in a row as they are
    assert got[1, 100].verbatim and not got[2, 100].verbatim and not {k for k in got if k[1] != 100}
    assert got[1, 100].windows == got[1, 100]["of"]
    assert found(spark, nothing).count() == 0
    items = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [4, 5, 6, 10, 12, None]))
    assert D.clean(docs, items.limit(0)).count() == len(TEXTS)


def test_whole_passages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    want = {(d, r.item_id) for r in items.collect() for d, t in texts if norm(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()}
    assert want and got >= want and len(got - want) <= 2


def test_plan_is_native(spark):
    docs = spark.createDataFrame(rows(TEXTS), COLUMNS)
    plan = found(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_count_though_the_alignment_conflicts(spark):
    item = "Anna has 3 red apples and 5 green pears in a basket by the door, and she gives 3 of them to every child who asks for fruit before noon today"
    texts = [
        (1, "so: " + item.replace("gives 3", "gives 9")), (2, "so: " + item.replace("3", "4").replace("5", "4")), (3, "so: " + item.replace("has 3", "has 6").replace("gives 3", "gives 9")),
        (4, "she has 6 red apples and 5 green pears but no basket"),
    ]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(100, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.matches(docs, items).collect()}
    assert set(got) == {1, 2, 3} and not any(r.verbatim for r in got.values())
    assert got[2].windows == got[2]["of"] and got[1].windows < got[1]["of"] and got[3].windows < got[3]["of"]


def test_items_that_templates_exclude_are_found_verbatim(spark):
    items = {
        1: "12 + 7 * 3 - 4 = 29 and 8 * 9 - 6 = 66", 2: "the Great Wall Of Northern Lights And Seven Other Tales From Old Harbour Towns", 3: "小明有三个苹果,他又买了五个苹果,现在一共有几个苹果?", 4: "What is osmosis?",
        5: "นักเรียนมีหนังสือสามเล่มและซื้อเพิ่มอีกสองเล่ม", 6: "photosynthesis",
    }
    texts = [(k, f"before, {t} after all") for k, t in items.items()] + [(13, f"这里写着:老师说{items[3]}大家想一想"), (20, "12 + 7 and 8 * 9; what is life, osmosis is; 小明有苹果; Great Wall"), (None, "so " + items[4]), (21, None), (22, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in D.matches(docs, spark.createDataFrame([*items.items(), (7, None), (8, ""), (None, "before after")], "item_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*((k, k) for k in items), (13, 3), (None, 4)]))
