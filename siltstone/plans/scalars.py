"""Queries of the scalar functions, over columns of the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import dates as T
from siltstone.functions import misc as G
from siltstone.functions import numbers as N
from siltstone.functions import strings as S
from siltstone.plans.registry import Registry
from siltstone.session import register, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
t = table
c = F.col


@R.add("""select l_orderkey, l_linenumber, l_quantity + l_tax as a, l_quantity - l_tax as s, round(l_quantity * l_tax, 6) as m, -l_partkey as neg,
l_partkey % nullif(l_linenumber - 1, 0) as md, (l_partkey // nullif(l_linenumber - 1, 0))::bigint as dv, round(cast(l_partkey as decimal(18,0)) / nullif(l_linenumber - 1, 0), 4)::double as q from lineitem""")
def math_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """+, -, *, unary minus, MOD, DIV and decimal division; by zero null (O-147 to O-150)."""
    z = c("l_linenumber") - 1
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("a"), (c("l_quantity") - c("l_tax")).alias("s"), F.round(c("l_quantity") * c("l_tax"), 6).alias("m"), (-c("l_partkey")).alias("neg"),
        N.modulo(c("l_partkey"), z).alias("md"), N.int_divide(c("l_partkey"), z).alias("dv"), N.divide(c("l_partkey"), z).cast("double").alias("q"),
    )


@R.add("""select l_orderkey, l_linenumber, (l_partkey | l_suppkey)::decimal(20,0) as o, (l_partkey & l_suppkey)::decimal(20,0) as a, xor(l_partkey, l_suppkey)::decimal(20,0) as x, (18446744073709551615 - l_partkey)::decimal(20,0) as inv,
case when l_linenumber * 12 >= 64 then 0 else (l_linenumber::hugeint << (l_linenumber * 12)) % 18446744073709551616::hugeint end::decimal(20,0) as l, (case when l_linenumber * 12 >= 64 then 0 else l_partkey >> (l_linenumber * 12) end)::decimal(20,0) as r, bit_count(l_partkey)::integer as n from lineitem""")
def math_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bit operators over 64 bits without sign, shifts of 64 and more, BIT_COUNT (O-151 to O-153)."""
    a, b, n = c("l_partkey"), c("l_suppkey"), c("l_linenumber") * 12
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", N.bit_or(a, b).alias("o"), N.bit_and(a, b).alias("a"), N.bit_xor(a, b).alias("x"), N.bit_not(a).alias("inv"),
        N.shift_left(c("l_linenumber"), n).alias("l"), N.shift_right(a, n).alias("r"), F.bit_count(a).alias("n"),
    )


@R.add("""select c_custkey, abs(c_acctbal) as a, sign(c_acctbal)::double as s, round(c_acctbal::decimal(12,2), 1)::double as r1, round(c_acctbal::decimal(12,2), 0)::double as r0, floor(c_acctbal)::bigint as f, round(sqrt(abs(c_acctbal)), 6) as q, round(sin(c_acctbal), 6) as si from customer""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    """ABS, SIGN, ROUND, FLOOR, SQRT, SIN (O-154 to O-159)."""
    x = c("c_acctbal")
    dec = x.cast("decimal(12,2)")
    return t(spark, d, "customer").select(
        "c_custkey", F.abs(x).alias("a"), F.sign(x).alias("s"), F.round(dec, 1).cast("double").alias("r1"), F.round(dec, 0).cast("double").alias("r0"), F.floor(x).alias("f"), F.round(F.sqrt(F.abs(x)), 6).alias("q"), F.round(F.sin(x), 6).alias("si")
    )


@R.add("""select c_custkey, round(pow(c_nationkey, 3), 4) as p, round(exp(c_nationkey / 10.0), 6) as e, round(ln(c_custkey + 1), 6) as l, round(log2(c_custkey + 1), 6) as l2, round(atan2(c_acctbal, 100), 6) as at, round(degrees(c_nationkey), 6) as dg,
ceil(c_acctbal)::bigint as ce, trunc(c_acctbal) as tr, greatest(c_nationkey, 7) as g, least(c_nationkey, 7) as le, md5(c_name) as m, (year(date '2020-03-31') * 100 + 2)::bigint + 0 * c_custkey as pa from customer""")
def math_extension(spark: SparkSession, d: str) -> DataFrame:
    """Functions that the reference's family commonly has, an extension (§2.18)."""
    x = c("c_acctbal")
    return t(spark, d, "customer").select(
        "c_custkey", F.round(F.pow("c_nationkey", F.lit(3)), 4).alias("p"), F.round(F.exp(c("c_nationkey") / 10.0), 6).alias("e"), F.round(F.ln(c("c_custkey") + 1), 6).alias("l"), F.round(F.log2(c("c_custkey") + 1), 6).alias("l2"),
        F.round(F.atan2(x, F.lit(100)), 6).alias("at"), F.round(F.degrees("c_nationkey"), 6).alias("dg"), F.ceil(x).alias("ce"), N.truncate(x, 0).cast("double").alias("tr"),
        F.greatest(c("c_nationkey"), F.lit(7)).alias("g"), F.least(c("c_nationkey"), F.lit(7)).alias("le"), F.md5(c("c_name").cast("binary")).alias("m"), T.period_add(F.lit(202003), F.lit(-1)).alias("pa"),
    )


@R.add("select count(*) as n, true as inside from region")
def math_random(spark: SparkSession, d: str) -> DataFrame:
    """RAND lies in [0, 1) (O-160)."""
    return t(spark, d, "region").select(F.rand().alias("r")).agg(F.count(F.lit(1)).alias("n"), F.every((c("r") >= 0) & (c("r") < 1)).alias("inside"))


@R.add("""select c_custkey, least(greatest(round((c_acctbal / 50)::decimal(38,9), 0), -128), 127)::tinyint as ti, least(greatest(round((c_acctbal * 10)::decimal(38,9), 0), -32768), 32767)::smallint as si,
least(greatest(round((c_acctbal * 1000000)::decimal(38,9), 0), -2147483648), 2147483647)::integer as i from customer""")
def store_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Rounding and clamping as a column stores a number (O-161, O-162)."""
    x = c("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", N.store(x / 50, "tinyint").alias("ti"), N.store(x * 10, "smallint").alias("si"), N.store(x * 1000000, "int").alias("i"))


@R.add("""select p_partkey, case when nullif(p_size, 5) is null then -1 else (p_size >= 10)::integer + (p_size >= 20)::integer + (p_size >= 30)::integer end as i from part""")
def interval_function(spark: SparkSession, d: str) -> DataFrame:
    """INTERVAL(n, …) with a null argument (O-163)."""
    return t(spark, d, "part").select("p_partkey", N.interval_index(F.nullif(c("p_size"), F.lit(5)), F.lit(10), F.lit(20), F.lit(30)).alias("i"))


@R.add("""select p_partkey, p_name || '/' || nullif(p_brand, 'Brand#11') as cc, concat_ws('-', p_name, nullif(p_brand, 'Brand#11'), 'x') as ws, strlen(p_name || 'é') as bl, length(p_name || 'é') as cl, substring(p_name, 3, 4) as su,
left(p_name, 4) as le, right(p_name, 3) as ri, upper(p_name) as up, lower(p_type) as lo, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 12, '-+') as rp, ltrim('  ' || p_name) as lt, rtrim(p_name || '  ') || '|' as rt from part""")
def string_basic(spark: SparkSession, d: str) -> DataFrame:
    """CONCAT, CONCAT_WS, LENGTH, CHAR_LENGTH, SUBSTRING, LEFT, RIGHT, UPPER, LOWER, LPAD, RPAD, LTRIM, RTRIM (O-164 to O-168, O-170 to O-175)."""
    n, b = c("p_name"), F.nullif(c("p_brand"), F.lit("Brand#11"))
    e = F.concat(n, F.lit("é"))
    return t(spark, d, "part").select(
        "p_partkey", F.concat(n, F.lit("/"), b).alias("cc"), F.concat_ws("-", n, b, F.lit("x")).alias("ws"), S.byte_length(e).cast("bigint").alias("bl"), F.char_length(e).cast("bigint").alias("cl"), F.substring(n, 3, 4).alias("su"),
        F.left(n, F.lit(4)).alias("le"), F.right(n, F.lit(3)).alias("ri"), F.upper(n).alias("up"), F.lower("p_type").alias("lo"), F.lpad("p_brand", 12, "*").alias("lp"), F.rpad("p_brand", 12, "-+").alias("rp"),
        F.ltrim(F.concat(F.lit("  "), n)).alias("lt"), F.concat(F.rtrim(F.concat(n, F.lit("  "))), F.lit("|")).alias("rt"),
    )


@R.add("""select p_partkey, array_to_string(string_split(p_type, ' ')[1:2], ' ') as si, array_to_string(string_split(p_type, ' ')[-1:], ' ') as sn, instr(p_name, 'a')::integer as lo, instr(p_brand, '#')::integer as ins, replace(p_name, 'a', '[A]') as re, repeat(left(p_name, 2), 3) as rp, reverse(p_name) as rv,
repeat(' ', p_size % 4) || '|' as sp, ascii(p_name) as asc, chr(65 + p_size % 26) as ch from part""")
def string_search(spark: SparkSession, d: str) -> DataFrame:
    """SUBSTRING_INDEX, LOCATE, INSTR, REPLACE, REPEAT, REVERSE, SPACE, ASCII, CHAR (O-169, O-176 to O-183)."""
    n = c("p_name")
    return t(spark, d, "part").select(
        "p_partkey", F.substring_index("p_type", " ", 2).alias("si"), F.substring_index("p_type", " ", -1).alias("sn"), F.locate("a", n).alias("lo"), F.instr("p_brand", "#").alias("ins"), F.replace(n, F.lit("a"), F.lit("[A]")).alias("re"),
        F.repeat(F.left(n, F.lit(2)), 3).alias("rp"), F.reverse(n).alias("rv"), F.concat(S.space(c("p_size") % 4), F.lit("|")).alias("sp"), F.ascii(n).alias("asc"), F.char(c("p_size") % 26 + 65).alias("ch"),
    )


@R.add("""select p_partkey, hex(p_name) as hx, hex(p_partkey) as hn, bin(p_partkey) as bn, decode(unhex(hex(p_name))) as un, case when p_name < p_type then -1 when p_name = p_type then 0 else 1 end as sc, format('{:,.2f}', p_retailprice * 1000) as fm from part""")
def string_codes(spark: SparkSession, d: str) -> DataFrame:
    """HEX, UNHEX, BIN, STRCMP, FORMAT (O-184 to O-188)."""
    return t(spark, d, "part").select(
        "p_partkey", F.hex("p_name").alias("hx"), F.hex("p_partkey").alias("hn"), F.bin("p_partkey").alias("bn"), F.decode(F.unhex(F.hex("p_name")), "UTF-8").alias("un"), S.compare(c("p_name"), c("p_type")).alias("sc"), F.format_number(c("p_retailprice") * 1000, 2).alias("fm")
    )


@R.add("""select p_partkey, case p_size % 5 when 1 then 'a' when 2 then 'b' when 3 then 'c' end as el, case p_brand when 'Brand#11' then 1 when 'Brand#12' then 2 when 'Brand#13' then 3 else 0 end as fi, coalesce(list_position(['1', '2', '7', '9'], (p_size % 10)::varchar), 0)::integer as fs,
concat_ws(',', case when p_size & 1 <> 0 then 'r' end, case when p_size & 2 <> 0 then 'w' end, case when p_size & 4 <> 0 then 'x' end) as ms,
concat_ws('|', case when p_size & 1 <> 0 then 'Y' else 'N' end, case when p_size & 2 <> 0 then 'Y' else 'N' end, case when p_size & 4 <> 0 then 'Y' else 'N' end) as es from part""")
def string_sets(spark: SparkSession, d: str) -> DataFrame:
    """ELT, FIELD, FIND_IN_SET, MAKE_SET, EXPORT_SET (O-189 to O-193)."""
    z, lit = c("p_size"), F.lit
    return t(spark, d, "part").select(
        "p_partkey", S.elt(z % 5, lit("a"), lit("b"), lit("c")).alias("el"), S.field(c("p_brand"), lit("Brand#11"), lit("Brand#12"), lit("Brand#13")).alias("fi"), F.find_in_set((z % 10).cast("string"), lit("1,2,7,9")).alias("fs"),
        S.make_set(z, lit("r"), lit("w"), lit("x")).alias("ms"), S.export_set(z, "Y", "N", "|", 3).alias("es"),
    )


@R.add("""select doc_id, coalesce(text, '') as text, strlen(text)::bigint as n, case when text is null then null else length(lower(text)) end as kept from documents""")
def string_compress(spark: SparkSession, d: str) -> DataFrame:
    """COMPRESS, UNCOMPRESS, UNCOMPRESSED_LENGTH (O-194)."""
    x = t(spark, d, "documents").select("doc_id", S.compress(c("text")).alias("z"), "text")
    back = S.uncompress(c("z"))
    return x.select("doc_id", F.coalesce(back, F.lit("")).alias("text"), F.when(c("z").isNotNull(), S.uncompressed_length(c("z")).cast("bigint")).alias("n"), F.char_length(F.lower("text")).cast("bigint").alias("kept"))


@R.add("""select c_custkey, sha1(c_name) as sh, (c_custkey % 256) * 16777216 + 513::bigint as ip, (c_custkey % 256)::varchar || '.0.2.1' as back, null::bigint as bad from customer""")
def string_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA1, INET_ATON and its reverse; an invalid address gives null (O-196, O-198)."""
    address = F.concat((c("c_custkey") % 256).cast("string"), F.lit(".0.2.1"))
    return t(spark, d, "customer").select("c_custkey", F.sha1(c("c_name").cast("binary")).alias("sh"), S.inet_aton(address).alias("ip"), S.inet_ntoa(S.inet_aton(address)).alias("back"), S.inet_aton(F.lit("1.2.3.400")).alias("bad"))


@R.add("select count(*) as n, count(*) as ids from customer")
def string_uuid(spark: SparkSession, d: str) -> DataFrame:
    """UUID: one for each row (O-200)."""
    return t(spark, d, "customer").select(F.uuid().alias("u")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("ids"))


@R.add("""select p_partkey, p_name as v, '<p><n>' || p_name || '</n><b>new</b></p>' as u from part""")
def string_xml(spark: SparkSession, d: str) -> DataFrame:
    """EXTRACTVALUE and UPDATEXML (O-201, O-202)."""
    xml = F.concat(F.lit("<p><n>"), c("p_name"), F.lit("</n><b>"), c("p_brand"), F.lit("</b></p>"))
    return t(spark, d, "part").select("p_partkey", S.extract_value(xml, "/p/n").alias("v"), S.update_xml(xml, "/p/b", "<b>new</b>").alias("u"))


@R.add("""select doc_id, regexp_replace(lang, '[^\\x00-\\x7F]', '?', 'g') as a, lang as u from documents""")
def string_charset(spark: SparkSession, d: str) -> DataFrame:
    """CONVERT(x USING charset) (O-195, O-272)."""
    return t(spark, d, "documents").select("doc_id", S.convert_charset(c("lang"), "ascii").alias("a"), F.decode(F.encode("lang", "UTF-8"), "UTF-8").alias("u"))


@R.add("""select s_suppkey, rtrim(s_name || '  ') = rtrim(s_name) as pad, true as sounds from supplier""")
def string_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Comparison without trailing spaces, SOUNDS LIKE (O-63, O-203)."""
    return t(spark, d, "supplier").select("s_suppkey", S.pad_equal(F.concat(c("s_name"), F.lit("  ")), c("s_name")).alias("pad"), S.sounds_like(c("s_name"), F.upper("s_name")).alias("sounds"))


@R.add("""select event_id, year(ts)::bigint as y, (year(ts) * 100 + month(ts))::bigint as ym, (day(ts) * 100 + hour(ts))::bigint as dh, (hour(ts) * 10000 + minute(ts) * 100 + second(ts))::bigint as hs,
(((day(ts) * 100 + hour(ts)) * 100 + minute(ts)) * 100 + second(ts))::bigint * 1000000 + microsecond(ts) % 1000000 as dm, (microsecond(ts) % 1000000)::bigint as f, quarter(ts)::bigint as q from events""")
def date_extract(spark: SparkSession, d: str) -> DataFrame:
    """EXTRACT of simple and compound units (O-204, O-216 to O-218)."""
    x = c("ts")
    return t(spark, d, "events").select("event_id", *(T.extract(u, x).alias(a) for u, a in (("YEAR", "y"), ("YEAR_MONTH", "ym"), ("DAY_HOUR", "dh"), ("HOUR_SECOND", "hs"), ("DAY_MICROSECOND", "dm"), ("MICROSECOND", "f"), ("QUARTER", "q"))))


@R.add("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as a, strftime(ts, '%d %b %y, day ') || lpad(dayofyear(ts)::varchar, 3, '0') as b, strftime(ts, '%A %B') as n, dayname(ts) as dn, monthname(ts) as mn from events""")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    """DATE_FORMAT, DAYNAME, MONTHNAME (O-205, O-221)."""
    x = c("ts")
    return t(spark, d, "events").select(
        "event_id", T.date_format(x, "%Y-%m-%d %H:%i:%s.%f").alias("a"), T.date_format(x, "%d %b %y, day %j").alias("b"), T.date_format(x, "%W %M").alias("n"), T.date_format(x, "%W").alias("dn"), T.date_format(x, "%M").alias("mn")
    )


@R.add("""select o_orderkey, o_orderdate + interval 40 day as a, o_orderdate + interval 13 month as m, o_orderdate - interval 1 year as y, o_orderdate + interval 90 minute as mi, o_orderdate - interval 3 week as w, o_orderdate + interval 1500 microsecond as us from orders""")
def date_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """DATE_ADD, DATE_SUB, ADDDATE, SUBDATE (O-206, O-207)."""
    x = c("o_orderdate")
    return t(spark, d, "orders").select(
        "o_orderkey", T.date_add(x, 40, "DAY").alias("a"), T.date_add(x, 13, "MONTH").alias("m"), T.date_sub(x, 1, "YEAR").alias("y"), T.date_add(x, 90, "MINUTE").alias("mi"), T.date_sub(x, 3, "WEEK").alias("w"), T.date_add(x, 1500, "MICROSECOND").alias("us")
    )


@R.add("""select o_orderkey, date_diff('day', date '1995-06-17', o_orderdate::date)::integer as dd, null::integer as bad, date_sub('month', timestamp '1990-01-15 12:00:00', o_orderdate)::bigint as tm, date_sub('hour', timestamp '1990-01-15 12:00:00', o_orderdate)::bigint as th,
(epoch(o_orderdate - timestamp '1995-06-17 12:30:00'))::double as sec from orders""")
def date_differences(spark: SparkSession, d: str) -> DataFrame:
    """DATEDIFF, also of an invalid date, TIMESTAMPDIFF, TIMEDIFF (O-208 to O-210)."""
    x, base = c("o_orderdate"), F.lit("1990-01-15 12:00:00").cast("timestamp_ntz")
    return t(spark, d, "orders").select(
        "o_orderkey", T.date_diff(x.cast("string"), F.lit("1995-06-17")).alias("dd"), T.date_diff(F.lit("1997-11-31"), F.lit("1997-11-01")).alias("bad"),
        F.timestamp_diff("MONTH", base, x).alias("tm"), F.timestamp_diff("HOUR", base, x).alias("th"), T.interval_seconds(T.time_diff(x, F.lit("1995-06-17 12:30:00").cast("timestamp_ntz"))).alias("sec"),
    )


@R.add("""with x as (select event_id, ts, event_id % 400 as n, (event_id % 60)::integer - 30 as h from events)
select event_id, ts + interval 25 hour + interval 1 second as ad, ts - interval 90 minute as su, case when n >= 1 then (date '2023-01-01' + (n - 1)::integer) end as md,
(case when h < 0 then '-' else '' end) || lpad(abs(h)::varchar, 2, '0') || ':11:12' as mt, (case when h < 0 then '-' else '' end) || lpad((abs(h) * 1000 // 3600)::varchar, 2, '0') || ':' || lpad((abs(h) * 1000 // 60 % 60)::varchar, 2, '0') || ':' || lpad((abs(h) * 1000 % 60)::varchar, 2, '0') as st,
(h * 1000)::double as ts2 from x""")
def time_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """ADDTIME, SUBTIME, MAKEDATE, MAKETIME with negative and long times, SEC_TO_TIME, TIME_TO_SEC (O-211 to O-213, O-226)."""
    n, h = c("event_id") % 400, (c("event_id") % 60).cast("int") - 30
    return t(spark, d, "events").select(
        "event_id", T.add_time(c("ts"), 25, 0, 1).alias("ad"), T.add_time(c("ts"), 0, -90).alias("su"), T.make_date(F.lit(2023), n).alias("md"), T.time_text(T.make_time(h, F.lit(11), F.lit(12))).alias("mt").alias("mt0"),
        T.time_text(T.sec_to_time(h * 1000)).alias("st"), T.interval_seconds(T.sec_to_time(h * 1000)).alias("ts2"),
    ).withColumnRenamed("mt0", "mt")


@R.add("""select event_id, ts::date as da, strftime(ts, '%H:%M:%S') as ti, day(ts)::integer as dy, hour(ts)::integer as h, minute(ts)::integer as mi, second(ts)::integer as s, weekofyear(ts)::integer as wy, strftime(ts, '%U')::integer as w0, strftime(ts, '%W')::integer as w5, weekofyear(ts)::integer as w3,
(date_diff('day', date '1970-01-01', ts::date) + 719528)::integer as td, epoch(date_trunc('second', ts))::bigint as ut, strftime(ts, '%Y/%m/%d') as fu from events""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """DATE, TIME, DAY, HOUR, MINUTE, SECOND, WEEK by mode, WEEKOFYEAR, TO_DAYS, UNIX_TIMESTAMP, FROM_UNIXTIME (O-215, O-217, O-219, O-220, O-222 to O-224)."""
    x = c("ts")
    return t(spark, d, "events").select(
        "event_id", F.to_date(x).alias("da"), F.date_format(x, "HH:mm:ss").alias("ti"), F.day(x).alias("dy"), F.hour(x).alias("h"), F.minute(x).alias("mi"), F.second(x).alias("s"), F.weekofyear(x).alias("wy"),
        T.week(x, 0).alias("w0"), T.week(x, 5).alias("w5"), T.week(x, 3).alias("w3"), T.to_days(x).alias("td"), F.unix_timestamp(x).alias("ut"), T.date_format(F.timestamp_seconds(F.unix_timestamp(x)), "%Y/%m/%d").alias("fu"),
    )


@R.add("""select event_id, try_strptime(strftime(ts, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') as a, null::timestamp as bad, ts::timestamp + interval 90 second as tt from events""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """STR_TO_DATE, also of what doesn't fit, TIMESTAMP(d, t) (O-214, O-225, O-230)."""
    x = c("ts")
    ntz = lambda v: v.cast("timestamp_ntz")
    return t(spark, d, "events").select("event_id", ntz(T.str_to_date(T.date_format(x, "%d.%m.%Y %H:%i"), "%d.%m.%Y %H:%i")).alias("a"), ntz(T.str_to_date(F.lit("1000-00-00"), "%Y-%m-%d")).alias("bad"), T.add_time(ntz(x.cast("string")), 0, 0, 90).alias("tt"))


@R.add("select event_id, (ts at time zone 'UTC' at time zone 'Asia/Tokyo') as a, (ts at time zone 'Europe/Berlin' at time zone 'UTC') as b from events")
def date_zones(spark: SparkSession, d: str) -> DataFrame:
    """CONVERT_TZ (O-228)."""
    return t(spark, d, "events").select("event_id", T.convert_tz(c("ts"), "UTC", "Asia/Tokyo").alias("a"), T.convert_tz(c("ts"), "Europe/Berlin", "UTC").alias("b"))


@R.add("select count(*) as n, true as now_is_today from region")
def date_now(spark: SparkSession, d: str) -> DataFrame:
    """NOW, CURDATE, CURRENT_TIMESTAMP agree within a query (O-227)."""
    return t(spark, d, "region").agg(F.count(F.lit(1)).alias("n"), F.every(F.to_date(F.now()) == F.current_date()).alias("now_is_today"))


@R.add("""select c_custkey, case when c_acctbal > 0 then 'plus' else 'minus' end as i, coalesce(nullif(c_mktsegment, 'BUILDING'), 'b') as n, coalesce(null, nullif(c_nationkey, 1), 0) as co,
case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 end as cs, case when c_nationkey < 5 then 'low' when c_nationkey < 15 then 'mid' else 'high' end as se, 7 as nc from customer""")
def conditional(spark: SparkSession, d: str) -> DataFrame:
    """IF, IFNULL, NULLIF, COALESCE, CASE in both forms, NAME_CONST (O-231 to O-235, O-241)."""
    register(spark, d, "customer")
    return spark.sql("""select c_custkey, if(c_acctbal > 0, 'plus', 'minus') as i, ifnull(nullif(c_mktsegment, 'BUILDING'), 'b') as n, coalesce(null, nullif(c_nationkey, 1), 0) as co,
    case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 end as cs, case when c_nationkey < 5 then 'low' when c_nationkey < 15 then 'mid' else 'high' end as se, 7 as nc from customer""")


@R.add("""select p_partkey, p_size::double as a, 0.0::double as z, (p_size + 0.5)::double as h from part""")
def implicit_number(spark: SparkSession, d: str) -> DataFrame:
    """Texts in numeric context: the leading number counts (O-238)."""
    n = c("p_size").cast("string")
    return t(spark, d, "part").select("p_partkey", S.number_prefix(F.concat(n, F.lit("abc"))).alias("a"), S.number_prefix(F.lit("abc")).alias("z"), S.number_prefix(F.concat(F.lit("  "), n, F.lit(".5x"))).alias("h"))


@R.add("select 1 as rows, true as named")
def session_functions(spark: SparkSession, d: str) -> DataFrame:
    """DATABASE, USER, VERSION (O-239)."""
    return spark.range(1).select(F.lit(1).alias("rows"), (F.current_database().isNotNull() & F.current_user().isNotNull() & F.version().isNotNull()).alias("named"))


@R.add("""select s_suppkey, s_acctbal as x, s_suppkey::double as y, 'POINT(' || s_acctbal::varchar || ' ' || s_suppkey::varchar || ')' as wkt, s_acctbal between 0 and 5000 and s_suppkey <= 100000 as hit from supplier""")
def spatial(spark: SparkSession, d: str) -> DataFrame:
    """GeomFromText, AsText, X, Y, Intersects on bounding boxes (O-242)."""
    g = F.concat(F.lit("Point( "), c("s_acctbal").cast("string"), F.lit("  "), c("s_suppkey").cast("string"), F.lit(" )"))
    x = t(spark, d, "supplier").withColumn("wkt", G.geometry(g))
    return x.select("s_suppkey", G.point_x(c("wkt")).alias("x"), G.point_y(c("wkt")).alias("y"), "wkt", G.intersects(c("wkt"), F.lit("POLYGON((0 0,5000 0,5000 100000,0 100000,0 0))")).alias("hit"))


@R.add("""select event_id, '7' || substr(props, 1, 0) as a, event_type in ('click', 'view') as has from events""")
def collections(spark: SparkSession, d: str) -> DataFrame:
    """Arrays and maps as an extension (O-243)."""
    m = F.create_map(F.lit("k"), F.lit("7"))
    return t(spark, d, "events").select("event_id", m["k"].alias("a"), F.array_contains(F.array(F.lit("click"), F.lit("view")), c("event_type")).alias("has"))


# user-defined functions


@R.add("select c_custkey, c_acctbal * 1.1 as v from customer")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    """A scalar function registered by name and used in SQL, over Arrow batches (O-249, O-251)."""
    @F.pandas_udf("double")
    def raised(x: pd.Series) -> pd.Series:
        return x * 1.1

    spark.udf.register("raised", raised)
    register(spark, d, "customer")
    return spark.sql("select c_custkey, raised(c_acctbal) as v from customer")


@R.add("select n_regionkey, round(exp(avg(ln(n_nationkey + 1))), 6) as g from nation group by 1")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate function with partial states (sum of logarithms, count), merged by the built-in aggregation (O-126, O-250)."""
    x = t(spark, d, "nation").withColumn("l", F.ln(c("n_nationkey") + 1))
    return x.groupBy("n_regionkey").agg(F.round(F.exp(F.sum("l") / F.count("l")), 6).alias("g"))


@R.add("select p_partkey, p_size * 3 + 1 as v from part")
def udf_sql(spark: SparkSession, d: str) -> DataFrame:
    """A stored function written in SQL (O-252)."""
    spark.sql("create or replace temporary function thrice_more(x int) returns int return x * 3 + 1")
    register(spark, d, "part")
    return spark.sql("select p_partkey, thrice_more(p_size) as v from part")


@R.add("select n_nationkey, unnest(string_split(n_name, ' ')) as word from nation")
def udtf_words(spark: SparkSession, d: str) -> DataFrame:
    """A table function: several rows for each row (O-254, O-255, O-258)."""

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in (text or "").split(" "):
                yield (w,)

    spark.udtf.register("words_of", Words)
    register(spark, d, "nation")
    return spark.sql("select n_nationkey, w.word from nation, lateral words_of(n_name) w")


@R.add("select 3 as v, 4 as w")
def session_variable(spark: SparkSession, d: str) -> DataFrame:
    """A session variable in expressions (O-49)."""
    spark.sql("declare or replace variable siltstone_v int default 1")
    spark.sql("set variable siltstone_v = 3")
    v = spark.sql("select siltstone_v as v").first()[0]
    return spark.sql("select :v as v, :v + 1 as w", {"v": v})
