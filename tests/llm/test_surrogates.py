"""Surrogates of many entities, of other countries' phone numbers and of names without a title."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from verbena.llm import pii

KEY = "a key of these tests"


def test_more_entities_than_short_surrogates(spark):
    """More family names than three syllables give, and all places of a format in use."""
    names = spark.range(130_000).select(
        F.lit("name_family").alias("kind"), F.concat(F.lit("F"), "id").alias("form")
    )
    mails = spark.range(100).select(
        F.lit("email").alias("kind"),
        F.format_string("%02d@host.example.com", "id").alias("form"),
    )
    # Hosts of one letter share their few surrogates.
    hosts = spark.range(26 * 10).select(
        F.lit("email").alias("kind"),
        F.concat(
            F.format_string("%d@", F.col("id") % 10),
            F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.floor(F.col("id") / 10).cast("int") + 1, F.lit(1)),
            F.lit(".co"),
        ).alias("form"),
    )
    every = names.unionByName(mails).unionByName(hosts)
    out = pii.assign(every, KEY)
    total = 130_000 + 100 + 260
    assert out.count() == total
    assert out.select("kind", "surrogate").distinct().count() == total
    assert out.join(every.select("kind", F.col("form").alias("surrogate")), ["kind", "surrogate"]).isEmpty()
    shapes = out.filter("form like '%@host.example.com'").collect()
    assert all(re.fullmatch(r"[0-9]{2,}@[a-z]{4}\.[a-z]{7}\.com", r["surrogate"]) for r in shapes)


PHONES = [
    "+33 6 12 34 56 78",
    "+44 20 7946 0958",
    "+44 (0)20 7946 0958",
    "+49 30 1234567",
    "+34 612 345 678",
    "+34612345678",
    "0034 612 345 678",
    "+351 21 123 4567",
    "06 12 34 56 78",
    "020 7946 0958",
    "030 1234567",
    "06.12.34.56.78",
    "555.123.4567",
    "(555)123-4567",
    "+1 (269) 555-3296",
]
PLAIN = ["2024-01-15", "01.02.2024 10", "1.2.3.4.5", "123 456", "3.0123456789", "1 000 000", "12:30:45", "+5 or 00"]


def anonymised(spark, texts, key=KEY):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.replace_entities(docs, key=key).collect()}


def test_phone_formats(spark):
    texts = [f"Call {p}, please." for p in PHONES] + [f"On {p}, so." for p in PLAIN]
    found = anonymised(spark, texts)
    for k, text in enumerate(texts):
        row = found[k]
        if k >= len(PHONES):
            assert row["text"] == text and not row["entities"], text
            continue
        assert [(e["kind"], e["start"], e["end"]) for e in row["entities"]] == [("phone", 5, 5 + len(PHONES[k]))]
        assert row["text"] != text
        assert re.sub("[0-9]", "0", row["text"]) == re.sub("[0-9]", "0", text)
    digits = lambda k, n: re.sub("[^0-9]", "", found[k]["text"])[-n:]
    of = PHONES.index
    assert digits(of("+33 6 12 34 56 78"), 9) == digits(of("06 12 34 56 78"), 9)
    assert digits(of("+44 20 7946 0958"), 10) == digits(of("020 7946 0958"), 10)
    assert digits(of("+44 (0)20 7946 0958"), 10) == digits(of("020 7946 0958"), 10)
    assert digits(of("+34 612 345 678"), 9) == digits(of("0034 612 345 678"), 9)


def test_names_without_a_title(spark):
    texts = [
        "Ivo Renn came. Mr Ivo Renn left; Renn and Ivo, not Renner nor Renn-Ott.",
        "Ivo Renn is not known here.",
        "Господин Иванов и Иванов. ivo@renn.org and Mrs Renn.",
    ]
    found = anonymised(spark, texts)
    m = re.fullmatch(r"(\w+) (\w+) came\. Mr (\w+) (\w+) left; (\w+) and (\w+), not Renner nor Renn-Ott\.", found[0]["text"])
    given, family = m[1], m[2]
    assert given != "Ivo" and family != "Renn"
    assert (m[3], m[4], m[5], m[6]) == (given, family, family, given)
    spans = [(e["kind"], texts[0][e["start"] : e["end"]]) for e in found[0]["entities"]]
    assert spans == [("name", x) for x in ("Ivo", "Renn", "Mr Ivo Renn", "Renn", "Ivo")]
    assert found[1]["text"] == texts[1]
    m = re.fullmatch(r"Господин (\w+) и (\w+)\. [a-z]+@[a-z]+\.org and Mrs (\w+)\.", found[2]["text"])
    assert m[1] == m[2] != "Иванов" and m[3] == family


def test_key_is_asked_for_and_used(spark):
    """No key, no surrogates; another key, others; the hash is the library's HMAC."""
    docs = spark.createDataFrame([(1, "Mr Ivo Renn")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pii.replace_entities(docs)
    spark.conf.set(pii.KEY_SETTING, "set")
    try:
        by_setting = pii.replace_entities(docs).first()["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert by_setting == pii.replace_entities(docs, key="set").first()["text"]
    assert by_setting != pii.replace_entities(docs, key="other").first()["text"]
    for key in ("k", "long " * 30, "ключ"):
        for message in ("", "ab|c", "Иван"):
            own = spark.range(1).select(pii.hmac(key, F.lit(message)).alias("h")).first()["h"]
            assert own == hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()


def luhn(digits):
    twice = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(twice) % 10


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


NUMBERS = [
    ("card", "4111 1111 1111 1111"),
    ("card", "5500-0000-0000-0004"),
    ("card", "4111111111111112"),  # fails the check
    ("iban", "DE89 3704 0044 0532 0130 00"),
    ("iban", "GB29NWBK60161331926819"),
    ("iban", "FR14 2004 1010 0505 0001 3M02 606"),
    ("iban", "DE88 3704 0044 0532 0130 00"),  # fails the check
    ("identity", "078-05-1120"),
    ("ip", "192.168.0.255"),
]
NO_ADDRESS = ["256.1.1.1", "1.2.3.400", "v 1.2.3.4", "v1.2.3.4", "version 10.0.0.1"]


def test_numbers_keep_kind_format_and_check_digits(spark):
    texts = [f"It is {n}, yes {n}." for _, n in NUMBERS] + [f"Take {n}, so." for n in NO_ADDRESS]
    found = anonymised(spark, texts)
    for k, (kind, number) in enumerate(NUMBERS):
        row = found[k]
        assert [(e["kind"], e["start"], e["end"]) for e in row["entities"]] == [
            (kind, 6, 6 + len(number)),
            (kind, 12 + len(number), 12 + 2 * len(number)),
        ], number
        first, second = re.fullmatch(r"It is (.+), yes (.+)\.", row["text"]).groups()
        assert first == second != number
        if kind == "ip":
            assert all(0 < int(x) < 255 for x in first.split("."))
            continue
        shape = lambda x: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x))
        assert shape(first) == shape(number)
        old, new = (re.sub("[ -]", "", x) for x in (number, first))
        if kind == "card":
            assert luhn(old) or luhn(new) == 0
        if kind == "iban":
            assert new[:2] == old[:2] and (mod97(old) != 1 or mod97(new) == 1)
    for k in range(len(NUMBERS), len(texts)):
        assert found[k]["text"] == texts[k] and not found[k]["entities"], texts[k]


def test_whole_table_against_a_plain_reading(spark, sf_dir):
    """Same mentions as Python finds, and a one-to-one map of spellings to surrogates for each kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in pii.replace_entities(docs, key=KEY).collect()}
    there, back, n = {}, {}, 0
    for doc in docs.collect():
        old, row = doc["text"] or "", rows[doc["doc_id"]]
        at, moved, spans = 0, 0, []
        for e in row["entities"]:
            assert old[at : e["start"]] == row["text"][at + moved : e["start"] + moved]
            rest = next((x["start"] for x in row["entities"] if x["start"] >= e["end"]), len(old))
            tail = old[e["end"] : rest]
            begin = e["start"] + moved
            end = row["text"].index(tail, begin + 1) if tail else len(row["text"])
            spans.append((e["kind"], old[e["start"] : e["end"]], row["text"][begin:end]))
            moved, at = end - e["end"], e["end"]
        assert old[at:] == row["text"][at + moved :]
        mails = re.findall(pii.PATTERNS["email"], old)
        assert [x for kind, x, _ in spans if kind == "email"] == mails
        for kind, a, b in spans:
            if kind in ("email", "ip"):
                a, b, n = a.lower(), b.lower(), n + 1
                assert there.setdefault((kind, a), b) == b
                assert back.setdefault((kind, b), a) == a
                assert a != b
    assert n > 0
