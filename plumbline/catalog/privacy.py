"""Personal data in text columns."""

from ..operators.privacy import privacy_scan
from ..session import table
from .registry import query

# the same shapes without look-around: what stands before a match is part of the pattern, numbers are whole tokens
COUNTS = r"""SELECT *, len(regexp_extract_all(t, '(?:^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b')) AS emails,
 len(regexp_extract_all(t, '(?:^|[^0-9A-Za-z])(?:\+1[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}\b')) AS phones,
 len(list_filter(regexp_extract_all(t, '[0-9A-Za-z-]+'), lambda x: regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND x[1:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:11] <> '0000')) AS ssns,
 len(list_filter(regexp_extract_all(t, '(?:^|[^0-9A-Za-z])([0-9](?:[ -]?[0-9]){12,18})\b', 1), lambda x:
  list_sum(list_transform(string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT ELSE d::INT * 2 - CASE WHEN d::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS cards"""


def scan_sql(columns: str, name: str) -> str:
    texts = " UNION ALL ".join(f"SELECT '{c}' AS col, regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F]', ' ', 'g') AS t FROM {name}" for c in columns.split())
    return f"""SELECT col, count(*) AS rows, sum(emails)::BIGINT AS emails, sum(phones)::BIGINT AS phones, sum(ssns)::BIGINT AS ssns, sum(cards)::BIGINT AS cards,
 count_if(emails + phones + ssns + cards > 0)::BIGINT AS flagged_rows, count_if(emails + phones + ssns + cards > 0) > 0 AS has_pii FROM ({COUNTS} FROM ({texts})) GROUP BY col"""


@query("privacy_scan", scan_sql("text source", "documents"))
def _(spark, d):
    return privacy_scan(table(spark, d, "documents"), ["text", "source"])


@query("privacy_scan_pages", scan_sql("url html", "pages"))
def _(spark, d):
    return privacy_scan(table(spark, d, "pages"))
