"""Values of scalar functions that a reader of the reference expects, and null handling."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates as T
from siltstone.functions import misc as G
from siltstone.functions import numbers as N
from siltstone.functions import strings as S

L = F.lit


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()[0]


def many(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_numbers(spark):
    big = L(-1).cast("bigint")
    got = many(
        spark, div=N.divide(L(8), L(5)), div0=N.divide(L(1), L(0)), idiv=N.int_divide(L(-7), L(2)), idiv0=N.int_divide(L(7), L(0)), mod=N.modulo(L(-7), L(3)), mod0=N.modulo(L(7), L(0)),
        shl=N.shift_left(L(1), L(63)), shl64=N.shift_left(L(1), L(64)), shr=N.shift_right(big, L(60)), shr64=N.shift_right(L(5), L(64)), inv=N.bit_not(L(0)), null=N.bit_or(L(None).cast("int"), L(1)),
        i55=N.interval_index(L(55), L(10), L(20), L(30), L(40), L(50), L(60)), inull=N.interval_index(L(None).cast("int"), L(1)), i0=N.interval_index(L(0), L(1)),
        t=N.store(L("127.5").cast("decimal(5,1)"), "tinyint"), tn=N.store(L(-200), "tinyint"), half=N.store(L("0.5").cast("decimal(2,1)"), "int"), none=N.store(L(None).cast("int"), "int"), cut=N.truncate(L(-1.999), 1),
    )
    assert got == {
        "div": Decimal("1.6000"), "div0": None, "idiv": -3, "idiv0": None, "mod": -1, "mod0": None, "shl": Decimal(2**63), "shl64": Decimal(0), "shr": Decimal(15), "shr64": Decimal(0), "inv": Decimal(2**64 - 1), "null": None,
        "i55": 5, "inull": -1, "i0": 0, "t": 127, "tn": -128, "half": 1, "none": None, "cut": -1.9,
    }


def test_strings(spark):
    null = L(None).cast("string")
    got = many(
        spark, f=S.field(L("b"), L("a"), L("b")), f0=S.field(null, L("a")), e=S.elt(L(3), L("a"), L("b")), m=S.make_set(L(5), L("a"), L("b"), L("c")), mn=S.make_set(L(3), null, L("b")), x=S.export_set(L(6), "1", "0", ",", 5),
        i=S.insert(L("Quadratic"), 3, 4, L("What")), io=S.insert(L("Quadratic"), 0, 4, L("What")), ip=S.inet_aton(L("10.0.5.9")), bad=S.inet_aton(L("10.0.5")), back=S.inet_ntoa(L(167773449)), cmp=S.compare(L("a"), L("b")),
        pad=S.pad_equal(L("a"), L("a ")), n=S.number_prefix(L("12.5e1abc")), z=S.number_prefix(L("x")), nn=S.number_prefix(null), re=S.regexp(L("ABC"), "^[[:lower:]b]+$"), rs=S.regexp(L("ABC"), "^[a-c]+$", fold=False),
        sp=S.space(L(-3)), xv=S.extract_value(L("<a><b>x</b><b>y</b></a>"), "/a/b"), xu=S.update_xml(L("<a><b>x</b></a>"), "/a/b", "<c/>"), xk=S.update_xml(L("<a><b>x</b><b>y</b></a>"), "/a/b", "<c/>"), xb=S.update_xml(L("no"), "/a", "z"),
        zip=S.uncompress(S.compress(L("köln"))), zl=S.uncompressed_length(S.compress(L("köln"))), zb=S.uncompress(L("junk").cast("binary")), cs=S.convert_charset(L("né"), "ascii"),
    )
    assert got == {
        "f": 2, "f0": 0, "e": None, "m": "a,c", "mn": "b", "x": "0,1,1,0,0", "i": "QuWhattic", "io": "Quadratic", "ip": 167773449, "bad": None, "back": "10.0.5.9", "cmp": -1, "pad": True, "n": 125.0, "z": 0.0, "nn": None,
        "re": True, "rs": False, "sp": "", "xv": "x y", "xu": "<a><c/></a>", "xk": "<a><b>x</b><b>y</b></a>", "xb": "no", "zip": "köln", "zl": 5, "zb": None, "cs": "n?",
    }


def test_dates(spark):
    ts = L("2003-12-31 01:02:03.000007").cast("timestamp_ntz")
    got = many(
        spark, ym=T.extract("YEAR_MONTH", ts), hm=T.extract("HOUR_MICROSECOND", ts), us=T.microsecond(ts), bad=T.date_diff(L("1997-11-31"), L("1997-11-01")), ok=T.date_diff(L("1997-12-31 23:59:59"), L("1997-12-30")),
        mt=T.time_text(T.make_time(L(-25), L(11), L(12))), mb=T.make_time(L(1), L(60), L(0)), md=T.make_date(L(1997), L(60)), m0=T.make_date(L(1997), L(0)), td=T.to_days(L("1997-10-07").cast("date")), fd=T.from_days(L(729669)),
        me=T.date_add(L("2008-01-31").cast("timestamp_ntz"), 1, "MONTH"), st=T.time_text(T.sec_to_time(L(100000))), ts=T.interval_seconds(T.sec_to_time(L(-61))), sd=T.str_to_date(L("2003-13-01"), "%Y-%m-%d"),
        pa=T.period_add(L(199801), L(-2)), q=T.date_format(ts, "it's %Y"), zero=T.safe_date(L("1000-00-00")),
    )
    assert got == {
        "ym": 200312, "hm": 10203000007, "us": 7, "bad": None, "ok": 1, "mt": "-25:11:12", "mb": None, "md": date(1997, 3, 1), "m0": None, "td": 729669, "fd": date(1997, 10, 7), "me": datetime(2008, 2, 29), "st": "27:46:40",
        "ts": -61.0, "sd": None, "pa": 199711, "q": "it's 2003", "zero": None,
    }


def brute_week(d: date, mode: int) -> int:
    """By counting days."""
    monday, four, zero = mode % 2 == 1, mode in (1, 3, 4, 6), mode in (0, 1, 4, 5)

    def first(year):
        day = date(year - 1, 12, 26)
        while True:
            if day.weekday() == (0 if monday else 6) and sum((day + timedelta(i)).year == year for i in range(7)) >= (4 if four else 7):
                return day
            day += timedelta(1)

    if d < first(d.year):
        return 0 if zero else (d - first(d.year - 1)).days // 7 + 1
    if not zero and d >= first(d.year + 1):
        return 1
    return (d - first(d.year)).days // 7 + 1


@pytest.mark.parametrize("mode", range(8))
def test_week(spark, mode):
    days = [date(y, m, d) for y in range(2000, 2012) for m, d in ((1, 1), (1, 2), (1, 3), (1, 4), (1, 7), (6, 15), (12, 26), (12, 28), (12, 30), (12, 31))]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [(r["d"], r["w"]) for r in df.select("d", T.week(F.col("d"), mode).alias("w")).collect()] == [(d, brute_week(d, mode)) for d in days]


def test_geometry(spark):
    got = many(spark, x=G.point_x(L("POINT(1 -2.5)")), y=G.point_y(L("POINT(1 -2.5)")), no=G.point_x(L("LINESTRING(1 1,2 2)")), g=G.geometry(L(" point( 1   2 )")), bad=G.geometry(L("circle(1)")), i=G.intersects(L("POINT(1 1)"), L("POLYGON((0 0,2 0,2 2,0 0))")), n=G.intersects(L("x"), L("POINT(1 1)")))
    assert got == {"x": 1.0, "y": -2.5, "no": None, "g": "POINT(1 2)", "bad": None, "i": True, "n": None}
