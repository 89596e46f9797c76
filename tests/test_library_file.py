import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from signalrank.operators import library
from signalrank.operators.versions import Tables
from signalrank.sources import foreign

ITEM, CREATOR = "item_id long, title string, abstract string", "item_id long, name string"


@pytest.fixture
def path(tmp_path):
    path = str(tmp_path / "library one.sqlite")
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE itemTypes (itemTypeID INTEGER PRIMARY KEY, typeName TEXT); CREATE TABLE items (itemID INTEGER PRIMARY KEY, itemTypeID INT, dateAdded TIMESTAMP, extra REAL);
        CREATE TABLE fields (fieldID INTEGER PRIMARY KEY, fieldName TEXT); CREATE VIEW fieldsCombined AS SELECT fieldID, fieldName FROM fields;
        CREATE TABLE itemDataValues (valueID INTEGER PRIMARY KEY, value); CREATE TABLE itemData (itemID INT, fieldID INT, valueID INT);
        CREATE TABLE creators (creatorID INTEGER PRIMARY KEY, firstName TEXT, lastName TEXT); CREATE TABLE itemCreators (itemID INT, creatorID INT, orderIndex INT);
        INSERT INTO itemTypes VALUES (1, 'journalArticle'), (2, 'note'); INSERT INTO fields VALUES (1, 'title'), (2, 'abstractNote'), (3, 'DOI'), (4, 'date'), (5, 'pages');
        INSERT INTO creators VALUES (1, 'Ann', 'Lee'), (2, NULL, ' Chan '), (3, '', ' ');
    """)
    value = 0
    for k in range(1, 41):
        con.execute("INSERT INTO items VALUES (?, ?, ?, ?)", (k * 3, 2 if k % 10 == 0 else 1, f"2024-01-{1 + k % 28:02d} 10:00:00" if k % 7 else "junk", k / 2))
        for field, text in ((1, f"Work {k} on land and towns"), (2, "An abstract of it." if k % 2 else None), (3, f"10.1/{k}" if k % 3 else None), (5, "1-2")):
            if text is not None and not (field == 1 and k % 9 == 0):
                value += 1
                con.execute("INSERT INTO itemDataValues VALUES (?, ?)", (value, text))
                con.execute("INSERT INTO itemData VALUES (?, ?, ?)", (k * 3, field, value))
        con.executemany("INSERT INTO itemCreators VALUES (?, ?, ?)", [(k * 3, c, c - 1) for c in (1, 2, 3)][: k % 4])
    con.commit()
    con.close()
    return path


def test_tables_of_a_foreign_file(spark, path):
    items = foreign.table_of(spark, path, "items", ["extra", "itemID"], 5)
    assert items.dtypes == [("extra", "double"), ("itemID", "bigint")] and items.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, items.collect())) == [(k / 2, 3 * k) for k in range(1, 41)]
    assert foreign.table_of(spark, path, "fieldsCombined", ["fieldName"]).count() == 5
    assert foreign.table_of(spark, path, "itemTypes", ["typeName"], 64).count() == 2
    with pytest.raises(Exception, match="no column nothing"):
        foreign.table_of(spark, path, "items", ["nothing"]).count()
    with pytest.raises(Exception):
        foreign.table_of(spark, path + "-missing", "items", []).count()


def test_library_is_what_its_export_says(spark, path):
    con = sqlite3.connect(path)
    export = con.execute("SELECT d.itemID, f.fieldName, v.value FROM itemData d JOIN fields f ON f.fieldID = d.fieldID JOIN itemDataValues v ON v.valueID = d.valueID").fetchall()
    works = {r[0] for r in con.execute("SELECT itemID FROM items WHERE itemTypeID = 1")}
    wide = library.pivot_items(spark.createDataFrame(export, "item_id long, field string, value string"), foreign.FIELDS).where("title is not null")
    want = sorted((r["item_id"], r["title"], r["abstractNote"], r["DOI"]) for r in wide.collect() if r["item_id"] in works)
    items = foreign.library_items(spark, path)
    assert sorted((r["item_id"], r["title"], r["abstract"], r["doi"]) for r in items.collect()) == want and len(want) == 32
    assert items.where("date_added is null").count() == len([k for k in works if k // 3 % 7 == 0 and k // 3 % 9])
    names = foreign.library_creators(spark, path).where("item_id = 9").orderBy("position").collect()
    assert [(r["position"], r["name"]) for r in names] == [(0, "Ann Lee"), (1, "Chan")]
    corpus = {r["item_id"]: r["text"] for r in foreign.library_corpus(items).collect()}
    assert corpus[3] == "Work 1 on land and towns An abstract of it." and len(corpus) == 32


@pytest.mark.parametrize("seed", [1])
def test_profile_of_batches_is_that_of_all_items(spark, tmp_path, seed):
    rng, words = random.Random(seed), "land wages town river growth trade school health the".split()
    sentence = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))])
    item = lambda k: (k, sentence(), sentence())
    items, creators = [item(k) for k in range(60)], [(k, rng.choice(["Ann Lee", "Bo Chan", "B. Chan", "", None])) for k in range(60) for _ in range(k % 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    profile = library.Profile(Tables(spark, f"file://{tmp_path}/profile"), ["the"])
    rng.shuffle(items)
    for number, batch in enumerate((items[:1], items[1:30], [], items[30:])):
        ids = {r[0] for r in batch}
        made = [c for c in creators if c[0] in ids]
        assert profile.add(frame(batch, ITEM), frame(made, CREATOR), done=("items", number))
        assert not profile.add(frame(batch, ITEM), frame(made, CREATOR), done=("items", number))

    def same(items, creators):
        limits = {"least_tf": 2, "most_df": 0.6, "most_terms": 6}
        rounded = lambda df: sorted((r[0], round(r[1], 9)) for r in df.collect())
        assert rounded(profile.terms(**limits)) == rounded(library.term_weights(frame(items, ITEM), ["the"], **limits))
        for got, want in zip(profile.authors(), library.author_weights(frame(creators, CREATOR))):
            assert rounded(got) == rounded(want)

    same(items, creators)
    old, new = items[:5], [(r[0], "land land reform", None) for r in items[1:5]]
    gone = {r[0] for r in old}
    profile.replace(frame(old, ITEM), frame([c for c in creators if c[0] in gone], CREATOR), frame(new, ITEM), frame([], CREATOR))
    same(items[5:] + new, [c for c in creators if c[0] not in gone])
    profile.compact()
    same(items[5:] + new, [c for c in creators if c[0] not in gone])
