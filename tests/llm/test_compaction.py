import pytest

from tessera.llm import compaction
from tessera.llm.common import Scratch


@pytest.fixture
def table(spark):
    return compaction.ShardedTable(spark, Scratch(spark, "t").root)


def small(spark, n, first=0):
    return spark.range(first, first + n).selectExpr("id as doc_id", "cast(null as string) as text", "'x' as path").coalesce(1)


def test_versions_stay_as_they_were_after_merges(spark, table):
    for k in range(5):
        assert table.append(small(spark, 3, 3 * k)) == k + 1
    assert table.compact() == 6 and len(table.manifest()[1]) == 1
    assert [table.read(v).count() for v in table.versions()] == [3, 6, 9, 12, 15, 15]
    assert table.compact() == 6 and table.append(small(spark, 0)) == 7 and table.read().count() == 15


def test_one_of_two_writers_commits(spark, table):
    table.append(small(spark, 2))
    base, shards, schema = table.manifest()
    mine, theirs = table.written(small(spark, 2, 2)), table.written(small(spark, 3, 5))
    table.commit(base, shards + theirs, schema)
    with pytest.raises(compaction.Conflict):
        table.commit(base, shards + mine, schema)
    assert table.read().count() == 5 and table.versions() == [1, 2]
    base, shards, schema = table.manifest()
    table.commit(base, shards + mine, schema)
    assert table.read().count() == 7


def test_expire_spares_listed_versions_and_writers_that_have_not_committed(spark, table):
    for k in range(4):
        table.append(small(spark, 2, 2 * k))
    table.compact()
    base, shards, schema = table.manifest()
    waiting = table.written(small(spark, 2, 50))
    assert table.expire() == 0 and table.versions() == [5]
    table.commit(base, shards + waiting, schema)
    assert table.read().count() == 10 and table.expire(versions=2, grace=0) == 4
    assert [table.read(v).count() for v in table.versions()] == [8, 10]


def test_empty_tables_repeats_and_nulls(spark, documents):
    rows = documents([(None, None), (1, "a"), (1, "a"), (2, "")], shards="s", size="z")
    made = compaction.compacted(rows, Scratch(rows.sparkSession, "t").root, rows_a_file=1)
    assert sorted(map(str, made.read().collect())) == sorted(map(str, rows.collect())) and made.read().columns == rows.columns
    none = compaction.compacted(documents([]), Scratch(rows.sparkSession, "t").root, rows_a_file=10)
    assert none.read().collect() == [] and none.versions() == [1]
