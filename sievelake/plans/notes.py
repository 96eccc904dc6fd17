"""Inputs of the queries: banking notes made from the order tables, and small fixtures.

Each is given as rows or as one SQL text that Spark and DuckDB both understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import spread

#: A note for every order, with findings of most categories.
NOTES = """
SELECT o_orderkey AS doc_id,
       'Name: ' || split_part('Arun,Ravi,Neha,Priya,Deepak,Sunil,Anita,Vikram', ',', CAST(o_orderkey % 8 + 1 AS INT))
       || ' ' || split_part('Sharma,Kumar,Mehta,Singh,Verma,Agarwal,Rao,Nair', ',', CAST(o_custkey % 8 + 1 AS INT))
       || ', Phone: 9' || lpad(CAST(o_custkey AS STRING), 9, '0')
       || ', Email: user' || CAST(o_custkey AS STRING) || '@bank' || CAST(c_nationkey AS STRING) || '.co.in'
       || ', Account: ' || lpad(CAST(o_orderkey AS STRING), 12, '0')
       || ', IFSC: HDFC0' || lpad(CAST(c_nationkey AS STRING), 6, '0')
       || ', Date: ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
       || ', Aadhaar: ' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || ' ' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' ' || lpad(CAST(c_nationkey AS STRING), 4, '0')
       || ', PAN: ABCPD' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || 'K'
       || ', Passport: K' || lpad(CAST(o_custkey AS STRING), 7, '0')
       || ', Address: ' || CAST(o_custkey % 999 AS STRING) || ' Park Avenue, City: Mumbai, Pincode: ' || CAST(400000 + o_custkey % 99 AS STRING)
       || ', Gender: ' || split_part('M,F,Male,Female', ',', CAST(o_orderkey % 4 + 1 AS INT)) || ', Age: ' || CAST(o_custkey % 60 + 18 AS STRING)
       || ', Time: ' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0')
       || ', status ' || o_orderstatus AS text,
       o_orderpriority AS priority
FROM orders JOIN customer ON c_custkey = o_custkey
"""

#: Texts and the categories that are expected in them.
COVERAGE = [
    (1, "Kiran Desai wrote from kiran_desai@post.example.org on turning 41; the form says Female", "FULLNAME,EMAIL,AGE,GENDER"),
    (2, "Ring 08123456789 before you come to 7 Lake Road, Pune 411004", "TELEPHONENUM,BUILDINGNUM,STREET,CITY,ZIPCODE"),
    (3, "Filed under PAN BQRCT4821M, voter card QWE7654321 and Aadhaar 9071 3345 1180", "PAN,VOTERID,AADHAAR"),
    (4, "Paid from account 50200031415926 (IFSC ICIC0004321) with card 5500 0000 0000 0004", "ACCOUNTNUM,IFSC,CREDITCARDNUM"),
    (5, "Seen at the counter: passport T7712345 and license KA 05 2019 0031337", "PASSPORTNUM,DRIVERLICENSENUM"),
    (6, "Txn: 0b6f1c9e-3d5a-4e7b-8a21-6c0d9f4b7e55 went through on 29-02-2024 at 23:59:07", "TRANSACTIONID,DATE,TIME"),
    (7, "Name: Meera Iyer, Mobile: +91 7012345678, Address: 19 Hill Lane, City: Kochi", "FULLNAME,TELEPHONENUM,STREET,CITY"),
    (8, "Vikram Rao Patel met Anita Shah by the river", "FULLNAME"),
    (9, "Holder Rohan Gupta, birth: 11/12/1975, Age: 49, Sex: M", "FULLNAME,DATE,AGE,GENDER"),
    (10, "Name: Tara Nair, Account Number: 778899001122, IFSC Code: UTIB0000077, Transaction ID: 9a3e5c70-1b2d-1c4e-9f60-718293a4b5c6", "FULLNAME,ACCOUNTNUM,IFSC,TRANSACTIONID"),
]

#: Findings to validate: category, word, score. Some are of the wrong category, some of none.
CASES = [
    ("FULLNAME", "Tara Nair", 0.95), ("GIVENNAME", "Tara", 0.9), ("SURNAME", "Nair", 0.9), ("TELEPHONENUM", "7012345678", 0.95), ("TELEPHONENUM", "+91 7012345678", 0.95),
    ("EMAIL", "t.nair@post.example.org", 0.95), ("CITY", "Kochi", 0.9), ("ZIPCODE", "682001", 0.9), ("BUILDINGNUM", "19", 0.85), ("PAN", "BQRCT4821M", 0.95),
    ("AADHAAR", "9071 3345 1180", 0.95), ("VOTERID", "QWE7654321", 0.95), ("DRIVERLICENSENUM", "KA 05 2019 0031337", 0.95), ("PASSPORTNUM", "T7712345", 0.95),
    ("ACCOUNTNUM", "778899001122", 0.9), ("IFSC", "UTIB0000077", 0.9), ("CREDITCARDNUM", "5500 0000 0000 0004", 0.9), ("DATE", "29-02-2024", 0.9), ("TIME", "23:59:07", 0.9),
    ("AGE", "49", 0.9), ("GENDER", "Female", 0.9), ("TRANSACTIONID", "0b6f1c9e-3d5a-4e7b-8a21-6c0d9f4b7e55", 0.9), ("VOTERID", "BQRCT4821M", 0.95),
    ("CREDITCARDNUM", "7012345678", 0.95), ("CITY", "Counter", 0.6), ("STREET", "0000-1111-2222", 0.9), ("TIME", "12 - 34 -", 0.903), ("PAN", "3345", 0.702),
    ("IFSC", "QWERT1234Y", 0.854), ("ZIPCODE", "Counter", 0.4), ("TIME", "682001", 0.9), ("TIME", "778899001122", 0.9), ("AGE", "Hill Lane", 0.9),
    ("AGE", "hill lane", 0.9), ("DATE", "49", 0.3), ("SSN", "x", 0.9), ("AGE", "", 0.9),
]

#: Raw findings of a model on the first texts of COVERAGE: doc_id, model, i, entity_group, entity, score, start, end.
TAGGED = [
    (1, "a", 0, "FULLNAME", None, "0.9", "11", "22"), (1, "a", 1, "", "AGE", "0.8", "29", "31"), (1, "b", 0, None, None, None, "0", "2"), (2, "a", 0, "CITY", "X", "high", "1", "2"),
    (2, "a", 1, "CITY", None, "0.7", None, "7"), (3, "b", 0, "PAN", None, "0.99", "5", "1e9x"), (3, "b", 1, "PAN", None, "0.99", "5", "15"), (4, "b", 0, "NONE", None, "0.2", "60", "9999"),
]

#: Class scores of a report: class, precision, recall, f1, support.
CLASSES = [("EMAIL", 1.0, 1.0, 1.0, 1512), ("ZIPCODE", 0.9979, 0.5771, 0.7313, 1641), ("AGE", 0.5, 0.25, 1 / 3, 716), ("PASSPORTNUM", 0.0, 0.0, 0.0, 0)]


#: Tokens that a model has labelled: doc_id, model, i, label, score, start, end, inside (a word that goes on).
TOKENS = [
    (1, "a", 0, "O", 0.9, 0, 2, False), (1, "a", 1, "B-FULLNAME", 0.8, 3, 7, False), (1, "a", 2, "I-FULLNAME", 0.6, 8, 11, False), (1, "a", 3, "I-CITY", 0.5, 11, 14, True), (1, "a", 4, "B-FULLNAME", 0.9, 15, 18, False),
    (1, "a", 5, "O", 0.9, 19, 20, False), (1, "a", 6, "FULLNAME", 0.4, 21, 25, False), (1, "b", 0, "I-CITY", 0.7, 0, 4, False), (1, "b", 1, "I-CITY", 0.5, 4, 6, True), (2, "a", 0, "O", 0.3, 0, 3, False),
    (2, "a", 1, "I-AGE", 0.75, 3, 5, True), (2, "a", 2, None, 0.3, 6, 9, False), (2, "a", 3, "I-AGE", 0.25, 10, 12, False), (2, "a", 4, "B-AGE", 0.5, 13, 15, False),
]

#: Prose about categories, as a text of numbered descriptions.
PROSE = """Categories

1. EMAIL
   - An address that mail is sent to.
   - Has one at sign.

2. AGE
   - Years, in digits.

3. IBAN
   - Not in the catalog.
"""

#: A short text for every order: blank ones and one with a finding.
SHORT = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE 'mail to a@b.cc' END AS text, o_orderpriority AS priority FROM orders
"""


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, priority."""
    return spark.sql(SHORT.replace("FROM orders", "FROM {orders}"), orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet")))


def notes(spark: SparkSession, sf_dir: str, part: int | None = None) -> DataFrame:
    """doc_id, text, priority; in a partition for so many bytes of orders, if part is given."""
    tables = {"orders": spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), part), "customer": spark.read.parquet(f"{sf_dir}/customer.parquet")}
    return spark.sql(NOTES.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), **tables)


def values_sql(rows: list[tuple], names: str) -> str:
    """Rows as a DuckDB table expression."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"
