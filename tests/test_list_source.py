"""Ranking lists as a data source: eras, title lines, folders, limits and what reaches the reader."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual
from test_sources import COMMON, system

from fleetfootprint.schemas import EFFICIENCY_LISTING
from fleetfootprint.sources.list_source import FORMAT, PushingListReader, RankingLists
from fleetfootprint.sources.lists import read_lists, read_performance_lists

OLD = f"Rank,{COMMON},Processors,RMax,RPeak"
NEW = f"Rank,{COMMON},Total Cores,Rmax [TFlop/s],Rpeak [TFlop/s]"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("lists")

    def write(name, *lines):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("\n".join(lines) + "\n")

    write("top_200506.csv", "TOP500 List of June 2005,,,", OLD, f"1,{system('titled')},8,10,20", f"2,{system('second', year='n/a')},x,9,")
    write("top_200711.csv", OLD, f"1,{system('untitled')},9,11,22")
    write("top_200806.csv", OLD, f"1,{system('later')},7,5,6")
    # a folder of files, columns in another order, a quoted comma and line break
    write("edition=2019_06/part-0.csv", NEW, f"1,{system('delta', 'USA')},6000,2,3")
    write("edition=2019_06/part-1.csv", f"Rpeak [TFlop/s],Rmax [TFlop/s],Total Cores,{COMMON},Rank", '4,3,12,S1,"AC,ME","two', 'lines",France,2015,1,1,p,Research,Europe,n,,,2')
    write("edition=2019_06/_SUCCESS", "")
    (root / "top_202011.csv.gz").write_bytes(gzip.compress(f"{NEW}\n1,{system('packed')},1,1,1\n".encode()))
    write("notes.txt", "no list")
    write("top_202106.csv", "")
    return str(root)


@pytest.fixture
def lists(spark):
    spark.dataSource.register(RankingLists)
    return spark.read.format(FORMAT)


def test_eras_titles_and_folders(lists, folder):
    got = {(r["rank_year"], r["computer"]): r for r in lists.load(folder).collect()}
    assert set(got) == {
        ("2005-06", "titled"), ("2005-06", "second"), ("2007-11", "untitled"), ("2008-06", "later"), ("2019-06", "delta"), ("2019-06", "two\nlines"), ("2020-11", "packed"),
    }
    titled, second, parts = got["2005-06", "titled"], got["2005-06", "second"], got["2019-06", "two\nlines"]
    assert (titled["cores"], titled["rmax"], titled["edition"], titled["listing"], titled["rank"]) == (8, 10, 2005.0, "Top500", 1)
    assert (second["year"], second["cores"], second["rpeak"], second["accel_name"]) == (None, None, None, None)
    assert (parts["rmax"], parts["rpeak"], parts["cores"], parts["manufacturer"], parts["rank"]) == (3000, 4000, 12, "AC,ME", 2)


def test_a_partition_a_file_and_limits(lists, folder):
    assert lists.load(folder).rdd.getNumPartitions() == 7
    few = lists.option("first", 2007.5).option("last", 2008.0).load(folder)
    assert few.rdd.getNumPartitions() == 2 and {r["computer"] for r in few.collect()} == {"untitled", "later"}


def test_conditions_on_the_edition_reach_the_reader(spark, folder):
    reader = PushingListReader(folder, "Top500", 0, 9999)
    conditions = [GreaterThan(("edition",), 2007.0), LessThanOrEqual(("edition",), 2019.0), EqualTo(("rank",), 1)]
    assert list(reader.pushFilters(conditions)) == conditions and [p.edition for p in reader.partitions()] == [2007.5, 2008.0, 2019.0, 2019.0]
    reader = PushingListReader(folder, "Top500", 0, 9999)
    list(reader.pushFilters([In(("edition",), (2008.0, 2005.0))]))
    assert [p.edition for p in reader.partitions()] == [2005.0, 2007.5, 2008.0]
    spark.dataSource.register(RankingLists)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        late = spark.read.format(FORMAT).option("pushdown", "true").load(folder).filter("edition >= 2019")
        assert late.rdd.getNumPartitions() == 4 and late.count() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_lists_equal_the_other_reader(spark, folder):
    paths = {(2007, 11): f"{folder}/top_200711.csv", (2008, 6): f"{folder}/top_200806.csv", (2020, 11): f"{folder}/top_202011.csv.gz"}
    plain = read_performance_lists(spark, paths)
    mine = read_lists(spark, folder).filter(F.col("rank_year").isin("2007-11", "2008-06", "2020-11"))
    assert sorted(mine.columns) == sorted(plain.columns)
    columns = sorted(plain.columns)
    assert sorted(map(str, mine.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert read_lists(spark, folder, n=1).count() == 5


def test_what_is_wrong_is_an_error(spark, lists, tmp_path):
    (tmp_path / "top_201506.csv").write_text(f"{OLD}\n1,{system('x')},1,2,3\n")
    with pytest.raises(Exception, match="Total Cores"):
        lists.load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="is none of"):
        spark.read.format(FORMAT).option("listing", "Fast").load(str(tmp_path))
    (tmp_path / "top_201506.csv").rename(tmp_path / "top_199006.csv")
    with pytest.raises(Exception, match="outside the known eras"):
        lists.load(str(tmp_path)).collect()


def test_efficiency_lists(spark, tmp_path):
    head = "Site,Computer,Country,Year,Name,Accelerator/Co-Processor,Accelerator/Co-Processor Cores,Total Cores,Rmax,Rpeak,Rank,Green500_Rank,Mflops/Watt,Power"
    (tmp_path / "green_2016_11.csv").write_text(f"{head}\nS1,alpha,France,2015,N,K20,40,160,9,10,8,4,7000,6\n")
    row = read_lists(spark, str(tmp_path), EFFICIENCY_LISTING).collect()[0]
    assert (row["rank"], row["top_rank"], row["gflops_per_watt"], row["power_kw"], row["accel_present"]) == (4, 8, 7, 6, True)
    assert "accel_name" not in row.asDict()
