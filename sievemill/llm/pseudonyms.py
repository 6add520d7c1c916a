"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Numbers that pass their format's check, dates, mail addresses and quoted hexadecimal secrets are replaced within the
text. A number is a pair (left, right) of residues; keyed rounds add a digest of one to the other, in turn, each modulo
its own size. That is a permutation of the format's valid values, so that equal values stay linked across documents,
different ones stay different, and nobody without the key can go back. What fails its check stays as it is. Addresses and
secrets have no fixed format to permute; they become cut keyed digests, which keep links and all but surely differences.

    kind     form                                    what is permuted
    card     13 to 19 digits, Luhn check             all digits but the last, which is the new check digit
    iban     country, check digits, account; mod 97  the account's digits, then new check digits
    ssn      AAA-GG-SSSS, valid ranges               area, and group with serial, within the valid ranges
    phone    +C (AAA) BBB-CCCC and like forms        the digits after the country code
    ip       four numbers up to 255                  all 32 bits
    date     YYYY-MM-DD or DD/MM/YYYY, 1900 to 2099  the day among the 73049 days
    email    local@domain                            local part and domain become keyed digests in .example form
    secret   32 to 64 quoted hexadecimal digits      every digit, by a keyed digest

Every keyed digest is an HMAC-SHA-256.

Defined results: null texts stay null with no replacements, empty ones empty; repeated rows and values get the same
pseudonyms; a very long text is one expression's value as any other; an empty table gives no rows; every other column stays,
and one named found is replaced.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")
#: Patterns of each kind, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}",
    "secret": r"(?<=[\"'])[0-9A-Fa-f]{32,64}(?=[\"'])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9/-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,5}){1,4}|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
_DAYS = (17, 4297)  # their product is the number of days from 1900 to 2099


def derived(key: str) -> Column:
    """struct(k1, k2): the key as HMAC's inner and outer blocks."""
    raw = key.encode()
    block = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return F.struct(*[F.lit(bytes(x ^ pad for x in block)).alias(k) for k, pad in (("k1", 0x36), ("k2", 0x5C))])


def keyed(key: Column, kind: str, *parts) -> Column:
    """HMAC-SHA-256 of a kind and parts, as hexadecimal digits; key: derived()."""
    text = F.concat_ws("|", F.lit(kind), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.sha2(F.concat(key["k2"], F.unhex(F.sha2(F.concat(key["k1"], F.encode(text, "UTF-8")), 256))), 256)


def _digest(key: Column, kind: str, *parts) -> Column:
    """60 bits of a keyed digest, as a long."""
    return F.conv(F.substring(keyed(key, kind, *parts), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """struct(l, r): the keyed permutation of (left, right) in Z_a x Z_b."""
    zero = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s, i):
        even = F.struct(((s["l"] + _digest(key, kind, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), ((s["r"] + _digest(key, kind, i, s["l"])) % b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, turn)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once: a let, by way of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """A permutation of the digit strings of each length."""

    def body(d):
        half = F.length(d).cast("int") / 2
        u = half.cast("int")
        v = F.length(d) - u
        ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
        number = lambda t: F.coalesce(t.try_cast("long"), F.lit(0))
        done = feistel(number(F.substr(d, F.lit(1), u)), number(F.substr(d, u + 1)), ten(u), ten(v), key, kind)
        return _bind(done, lambda s: F.concat(F.when(u > 0, F.lpad(s["l"].cast("string"), u, "0")).otherwise(""), F.lpad(s["r"].cast("string"), v, "0")))

    return _bind(digits, body)


def _fill(form: Column, digits: Column) -> Column:
    """form with its digits replaced by `digits`, in order."""
    return _bind(digits, lambda d: F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(d, F.length(_digits(F.substr(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that a check digit would follow."""
    total = lambda s, x: s + x
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _bind(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), total)


def _mod97(text: Column) -> Column:
    """The account check's remainder: letters count 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97)


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    valid = (_luhn_sum(body) + F.substr(d, F.length(d)).cast("int")) % 10 == 0
    new = _bind(_permute_digits(body, key, "card"), lambda x: F.concat(x, ((10 - _luhn_sum(x) % 10) % 10).cast("string")))
    return F.when(valid, _fill(m, new))


def _iban(m: Column, key: Column) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(c, 1, 2), F.substr(c, F.lit(5))
    valid = (_mod97(F.concat(account, country, F.substring(c, 3, 2))) == 1) & F.length(c).between(15, 34)
    own = _digits(account)
    new = _fill(account, F.when(F.length(own) > 0, _permute_digits(own, key, "iban")).otherwise(""))
    check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
    # The blanks of the old form come back.
    blanks = lambda t: F.array_join(F.transform(F.split(m, ""), lambda ch, i: F.when(ch == " ", " ").otherwise(F.substr(t, F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return F.when(valid, _bind(_bind(new, lambda x: F.concat(country, check(x), x)), blanks))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new = _bind(done, lambda s: F.format_string("%03d-%02d-%04d", F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1), (s["r"] / 9999).cast("long") + 1, s["r"] % 9999 + 1))
    return F.when(valid, new)


def _phone(m: Column, key: Column) -> Column:
    # The country code stays: what stands before the first blank, bracket, point or dash of a number with a plus.
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})", 1)
    rest = F.substr(m, F.length(code) + 1)
    valid = F.length(_digits(rest)).between(6, 14)
    return F.when(valid, F.concat(code, _fill(rest, _permute_digits(_digits(rest), key, "phone"))))


def _ip(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(parts, lambda x: x < 256)
    at = lambda k: F.element_at(parts, k)
    done = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536), key, "ip")
    return F.when(valid, _bind(done, lambda s: F.format_string("%d.%d.%d.%d", F.shiftright(s["l"], 8), s["l"] % 256, F.shiftright(s["r"], 8), s["r"] % 256)))


def _date(m: Column, key: Column) -> Column:
    iso = F.substring(m, 5, 1) == "-"
    day = F.coalesce(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")), F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))).cast("date")
    number = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    done = feistel((number / _DAYS[1]).cast("long"), number % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), (done["l"] * _DAYS[1] + done["r"]).cast("int"))
    return F.when(day.isNotNull(), _bind(new, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))))


def _email(m: Column, key: Column) -> Column:
    low = F.lower(m)
    tag = lambda kind, part, n: F.substring(keyed(key, kind, part), 1, n)
    return F.concat(F.lit("u"), tag("email", low, 16), F.lit("@d"), tag("domain", F.substring_index(low, "@", -1), 8), F.lit(".example"))


def _secret(m: Column, key: Column) -> Column:
    return F.substr(keyed(key, "secret", F.lower(m)), F.lit(1), F.length(m))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """Which kind a match is of, by its shape."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike("^[0-9A-Fa-f]{32,64}$"), "secret").when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"), "date").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"), "card").otherwise("phone")
    )


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a match, null if it fails its check."""
    out = None
    for k in KINDS:
        out = F.when(kind == k, _MAKERS[k](m, key)) if out is None else out.when(kind == k, _MAKERS[k](m, key))
    return out


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with pseudonyms in `column`, and found: array of (kind, pseudonym) in order of place."""
    secret = derived(key)
    text = F.col(f"doc.`{column}`")
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    replaced = F.transform(matches, lambda m: _bind(kind_of(m), lambda kind: F.struct(m.alias("was"), kind.alias("kind"), pseudonym(m, kind, secret).alias("new"))))
    # Only texts with a digit or an @ are searched at all.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("hits", F.when(text.rlike("[0-9@]"), replaced))
    between = F.split(text, ANY, -1)
    joined = F.concat(F.element_at(between, 1), F.array_join(F.zip_with("hits", F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(1))), lambda r, t: F.concat(F.coalesce(r["new"], r["was"]), t)), ""))
    rebuilt = F.when(F.coalesce(F.exists("hits", lambda r: r["new"].isNotNull()), F.lit(False)), joined).otherwise(text)
    found = F.transform(F.filter("hits", lambda r: r["new"].isNotNull()), lambda r: F.struct(r["kind"].alias("kind"), r["new"].alias("pseudonym")))
    own = [(rebuilt if c == column else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns if c != "found" or c == column]
    return rows.select(*own, F.coalesce(found, F.array().cast("array<struct<kind:string,pseudonym:string>>")).alias("found"))
