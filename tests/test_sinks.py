"""CSV exports: quoting rules of the download format."""
import glob

from churnwise.sources.sinks import as_records, write_csv


def test_quote_all_csv(spark, tmp_path):
    df = spark.createDataFrame([('a"b', None, 1.5)], "name string, seg string, v double")
    out = str(tmp_path / "csv")
    write_csv(df.coalesce(1), out, quote_all=True)
    text = open(glob.glob(out + "/part-*.csv")[0]).read().splitlines()
    assert text[0] == '"name","seg","v"'
    assert text[1] == '"a""b","","1.5"'


def test_records(spark):
    df = spark.createDataFrame([("c1", 2)], "customer_unique_id string, n int")
    assert as_records(df).collect()[0][0] == '{"customer_unique_id":"c1","n":2}'


def test_uploaded_csv_mapping(spark, tmp_path):
    import pytest
    from churnwise.sources.tables import load_uploaded_csv
    p = tmp_path / "up.csv"
    p.write_text("cust,when,amount,extra\nA,2020-01-02 10:00:00,12.5,x\nB,not a date,3,y\n")
    df = load_uploaded_csv(spark, str(p), "cust", "when", "amount")
    rows = sorted(df.select("customer_id", "order_ts", "value").collect())
    assert rows[0].customer_id == "A" and rows[0].value == 12.5 and rows[0].order_ts is not None
    assert rows[1].order_ts is None                      # unparsable date -> null
    with pytest.raises(ValueError):
        load_uploaded_csv(spark, str(p), "cust", "when", "missing_col")


def test_uploaded_rows_get_ids_that_do_not_depend_on_the_layout(spark, tmp_path):
    from churnwise.sources.tables import load_uploaded_csv
    p = tmp_path / "up.csv"
    p.write_text("cust,when,amount\n" + "A,2020-01-02,1\nB,2020-01-03,2\nA,2020-01-02,1\n,2020-01-03,\n" * 3)
    first = load_uploaded_csv(spark, str(p), "cust", "when", "amount").collect()
    q = tmp_path / "parts"
    q.mkdir()
    lines = p.read_text().splitlines()
    (q / "a.csv").write_text("\n".join([lines[0], *reversed(lines[1:5])]) + "\n")
    (q / "b.csv").write_text("\n".join([lines[0], *lines[5:]]) + "\n")
    again = load_uploaded_csv(spark, str(q), "cust", "when", "amount").collect()
    assert len(first) == 12 and len({r.order_id for r in first}) == 12
    assert sorted(map(str, first)) == sorted(map(str, again))
