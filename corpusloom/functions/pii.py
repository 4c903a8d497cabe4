"""Personal data by patterns: sequential redaction and independent counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import EMAIL, WS

# Fixed values: (name, pattern, placeholder) in the order of redaction.
PLAIN = [
    ("phone_cn", "1[3-9][0-9]{9}", "<PHONE>"),
    ("id_card", "[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]", "<ID>"),
    ("email", EMAIL, "<EMAIL>"),
    ("ip_address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<IP>"),
    ("bank_card", "[0-9]{16,19}", "<BANK>"),
]
#: (name, keyword, number, placeholder): the keyword stays.
CONTEXT = [
    ("qq", f"(?:QQ|qq|Q号|企鹅号){WS}*[：:]*{WS}*", r"[1-9][0-9]{4,10}\b", "<QQ>"),
    ("passport", f"(?:护照|passport|通行证){WS}*[：:]*{WS}*", "[A-Z][0-9]{8,9}", "<PASSPORT>"),
    ("phone_fix", f"(?:电话|tel|fax|座机|固话|传真){WS}*[：:]*{WS}*", f"[0-9]{{3,4}}(?:-|{WS})?[0-9]{{7,8}}", "<PHONE>"),
]
COMPOUND = [
    ("address", f"(?:地址|住址|家庭地址|通讯地址|收货地址)(?:[：:]|{WS})*[^\\n]{{10,60}}", "<ADDR>"),
    ("name_phone", rf"[\x{{4e00}}-\x{{9fff}}]{{2,4}}(?:[：:]|{WS})*1[3-9][0-9]{{9}}", "<PII>"),
]
#: What every kind holds: a text without any of these has none.
NEEDED = "[0-9@址]"
#: Name to pattern of all kinds.
PATTERNS = {n: p for n, p, _ in PLAIN} | {n: f"{k}{p}" for n, k, p, _ in CONTEXT} | {n: p for n, p, _ in COMPOUND}


def redact(text: Column, plain=PLAIN, context=CONTEXT, compound=COMPOUND) -> Column:
    """Each kind is replaced in what the kinds before it left.  Own kinds may hold anything; the fixed ones are looked for only where one can be."""
    out = text
    for _, pattern, by in plain:
        out = F.regexp_replace(out, pattern, by)
    for _, keyword, number, by in context:
        out = F.regexp_replace(out, f"({keyword})({number})", f"$1{by}")
    for _, pattern, by in compound:
        out = F.regexp_replace(out, pattern, by)
    fixed = plain is PLAIN and context is CONTEXT and compound is COMPOUND
    return F.when(text.rlike(NEEDED), out).otherwise(text) if fixed else out


def counts(text: Column) -> dict[str, Column]:
    """Matches of each kind in the text as it is."""
    n = {name: F.regexp_count(text, F.lit(p)) for name, p in PATTERNS.items()}
    return n | {"email": F.when(~F.contains(text, F.lit("@")), F.lit(0)).otherwise(n["email"])}


def total(text: Column) -> Column:
    return F.when(~text.rlike(NEEDED), F.lit(0)).otherwise(sum(counts(text).values(), F.lit(0)))


def has_pii(text: Column) -> Column:
    out = F.lit(False)
    for p in PATTERNS.values():
        out = out | text.rlike(p)
    return text.rlike(NEEDED) & out
