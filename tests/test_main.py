import datetime as dt

from shelfcast.__main__ import main


def write_sales(path, days):
    rows = ["Order ID,Order Date,Ship Date,Customer ID,Segment,Region,Product ID,Category,Sub-Category,Product Name,Sales,Quantity,Discount,Profit"]
    for i in range(days):
        d = (dt.date(2016, 1, 1) + dt.timedelta(days=i)).strftime("%m/%d/%Y")
        rows.append(f"O{i},{d},{d},C{i % 5},Consumer,West,P{i % 3},Tech,Phones,Phone,{100 + 10 * (i % 7)},1,0,5")
    path.write_text("\n".join(rows))


def test_report_and_features(spark, tmp_path, capsys):
    write_sales(tmp_path / "s.csv", 140)
    main(["report", str(tmp_path / "s.csv")])
    assert "total_rows: 140" in capsys.readouterr().out
    main(["features", str(tmp_path / "s.csv")])
    out = capsys.readouterr().out
    assert "36 features" in out and "train" in out
