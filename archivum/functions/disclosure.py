"""Disclosure scan: text made canonical, then credentials, personal data and pay."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that don't show, in their order.
INVISIBLE = [
    0x00AD, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D,
    0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF,
]
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "М": "M", "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Т": "T", "В": "B", "Н": "H", "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "У": "Y", "Х": "X",
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "Ι": "I", "Β": "B", "Α": "A", "Ε": "E", "Ο": "O", "Ρ": "P", "Υ": "Y", "Χ": "X",
}
#: Credentials, by provider.
CREDENTIALS = [
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[0-9A-Za-z]{36,255}\b",
    r"\bglpat-[0-9A-Za-z_-]{20,22}\b",
    r"\bxox[baprs]-[0-9A-Za-z-]{10,72}\b",
    r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,99}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\bsk-(?:ant-)?[0-9A-Za-z_-]{20,200}\b",
    r"\bnpm_[0-9A-Za-z]{36}\b",
    r"\bSG\.[0-9A-Za-z_-]{16,32}\.[0-9A-Za-z_-]{16,64}\b",
    r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
]
#: Personal data, pay, shares, and what makes a share one of pay.
PERSONAL = r"(?i:[0-9]{3}-[0-9]{2}-[0-9]{4}|\bSSN\b|social security (?:number|no)|background[- ]check (?:result|report|passed|failed)|date of birth|\bDOB\b\s*[:=])"
PAY = r"(?i:\bsalary\b|base pay\b|take[- ]home pay\b|(?:launch|signing|sign[- ]on) bonus|equity\s+(?:stakes?|grants?|granted|options?)\b|equity\s+[0-9]|\bvesting\b|\bRSUs?\b|stock options?\b|revenue[- ]share\s*[0-9]|7[- ]bucket)"
SHARES = r"(?i:[0-9]{1,3}\s*/\s*[0-9]{1,3}\s*(?:split|share)|[0-9]{1,2}\s*/\s*[0-9]{1,2}\s*(?:max|→|->)\s*[0-9]{1,2}\s*/\s*[0-9]{1,2})"
PAY_CONTEXT = r"(?i:\b(?:compensation|comp|revenue|profit|equity|payout|royalty|salary|wage|bonus|earnings)\b|take[- ]home)"
#: Columns of closed vocabularies, which hold no free text.
CLOSED = ["status", "source", "category", "trust_level", "confidence", "sensitivity", "type"]


def _nfkc(text: Column) -> Column:
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(fold, "string")(text)


def canonical(text: Column) -> Column:
    """One percent-decoding (the text itself where it can't be decoded), NFKC
    (no built-in has it: an Arrow function), invisible characters out, and
    look-alikes as the letters they look like. Null stays null."""
    open_text = F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)
    shown = F.regexp_replace(_nfkc(open_text), "[" + "".join(map(chr, INVISIBLE)) + "]", "")
    return F.translate(shown, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def category(clean: Column) -> Column:
    """secret, pii or compensation, the first that applies to a canonical
    text, or null."""
    return F.when(clean.rlike("|".join(f"(?:{p})" for p in CREDENTIALS)), "secret").when(clean.rlike(PERSONAL), "pii").when(clean.rlike(PAY), "compensation").when(clean.rlike(SHARES) & clean.rlike(PAY_CONTEXT), "compensation")


def free_text(schema) -> list[str]:
    """The string columns of a table but those of closed vocabularies."""
    return [f.name for f in schema if f.dataType.simpleString() == "string" and f.name not in CLOSED]


def scanned(df, out: str = "disclosure"):
    """Adds the category of the first free-text column, in the order of the
    table, that discloses anything; null where none does."""
    names = free_text(df.schema)
    for k, name in enumerate(names):
        df = df.withColumn(f"__clean{k}", canonical(F.col(f"`{name}`")))
    found = F.coalesce(*[category(F.col(f"__clean{k}")) for k in range(len(names))], F.lit(None).cast("string"))
    return df.withColumn(out, found).drop(*[f"__clean{k}" for k in range(len(names))])
