"""Format-preserving pseudonyms by an alternating Feistel network, in column functions only.

A value is cut into two halves; eight times in turn one half is shifted, each character within its class (digits, lower
case, upper case), by a keyed digest of the other half. That is a permutation of all values of the same format, so equal
values get equal pseudonyms in every document and different values different ones. Values with check rules stay valid:
check digits are computed anew, dates move within a calendar cycle, address octets within 0 to 255, and formats that rule
out some digits are walked on until the value is allowed. Cards are looked for among the whole digit groups of a run of
digits, so that a number beside a card does not hide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.packed import fresh

ROUNDS = 8
_DAYS = (189, 773)  # their product is the days of the 400-year calendar cycle
_FIRST_DAY = "1800-01-01"
_WALK = 24

# What is looked for; every pattern begins at the edge of a token, so that the search is linear in the text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
SECRET = r"(?<![A-Za-z0-9_])(?i:password|passwd|token|secret|api_key)\s?[=:]\s?\"?[A-Za-z0-9+/_-]{8,}+\"?"
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
# Lengths by country, for IBANs printed in groups of four.
_IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
                 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR",
                 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA", 30: "KW MU", 31: "MT"}
IBAN_SPACED = r"(?<![A-Za-z0-9])(?:" + "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + f" [A-Z0-9]{{{n % 4}}}" * (n % 4 > 0)
    for n, c in _IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
PHONE = r"(?<![A-Za-z0-9])\+1 ?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
# Other country codes; national digits are counted where their number is fixed, so that a number behind stays out.
_COUNTRY = r"(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_NATIONAL = {"(?:27|31|33|34|41|48|61)": "9", "(?:7|44|52|90|91)": "10", "86": "11", _COUNTRY: "6,11"}
PHONE_ABROAD = r"(?<![A-Za-z0-9])\+(?:" + "|".join(
    c + r"(?: ?\(0\))?(?:[ .-]?[0-9]){" + n + r"}(?![0-9])" for c, n in _NATIONAL.items()) + ")"
PHONE_LOCAL = r"(?<![A-Za-z0-9.+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
# Dates of other forms, by the name of their kind: the pattern, and the forms that are tried in turn.
DATES = {"date_slashes": (r"(?<![0-9/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])", ["yyyy/MM/dd"]),
         "date_points": (r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])", ["dd.MM.yyyy"]),
         "date_day_first": (r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])", ["dd/MM/yyyy", "MM/dd/yyyy"])}
# A run of digit groups up to a value of another kind; the cards are whole groups of it.
CARD = (r"(?<![0-9])(?=(?:[ -]?[0-9]){13})[0-9]++(?:[ -](?!" + "|".join([EMAIL, ADDRESS, DATE, SSN, PHONE_LOCAL, *(p for p, _ in DATES.values())])
        + r")[0-9]++)*+")
KINDS = {"email": EMAIL, "secret": SECRET, "access_key": ACCESS_KEY, "iban": IBAN, "iban_spaced": IBAN_SPACED, "phone": PHONE,
         "phone_abroad": PHONE_ABROAD, "phone_local": PHONE_LOCAL, "address": ADDRESS, "date": DATE,
         **{kind: p for kind, (p, _) in DATES.items()}, "ssn": SSN, "card": CARD}
PATTERN = "|".join(KINDS.values())


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _number(key: str, kind: str, turn: Column, other: Column) -> Column:
    """A keyed number below 2^48."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _shift(half: Column, other: Column, turn: Column, key: str, kind: str) -> Column:
    """Each letter and digit of ``half`` moved within its class; other characters stay."""
    def moved(c: Column, i: Column) -> Column:
        code, by = F.ascii(c), _number(key, kind, turn, F.concat_ws("|", i.cast("string"), other))
        within = lambda low, size: F.chr(F.lit(low) + (code - low + by) % size)
        return (F.when(c.between("0", "9") & (F.octet_length(c) == 1), within(48, 10))
                .when(c.between("a", "z") & (F.octet_length(c) == 1), within(97, 26))
                .when(c.between("A", "Z") & (F.octet_length(c) == 1), within(65, 26)).otherwise(c))

    return F.array_join(F.transform(_chars(half), moved), "")


def _feistel(left: Column, right: Column, step) -> Column:
    """struct(l, r) after the rounds; step(half, other, turn) gives the new half."""
    start = F.struct(left.alias("l"), right.alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        return F.struct(F.when(k % 2 == 1, step(acc["l"], acc["r"], k)).otherwise(acc["l"]).alias("l"),
                        F.when(k % 2 == 0, step(acc["r"], acc["l"], k)).otherwise(acc["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permuted(s: Column, key: str, kind: str) -> Column:
    """``s`` permuted among the strings of its format."""
    middle = F.ceil(F.length(s) / 2).cast("int")
    halves = _feistel(F.substring(s, F.lit(1), middle), F.substring(s, middle + 1, F.length(s)),
                      lambda half, other, k: _shift(half, other, k, key, kind))
    return F.concat(halves["l"], halves["r"])


def _walked(s: Column, key: str, kind: str, allowed: str) -> Column:
    """Permuted again until the value matches ``allowed``, which keeps it a permutation of the allowed values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), permuted(s, key, kind),
                       lambda acc, _: F.when(acc.rlike(f"^(?:{allowed})$"), acc).otherwise(permuted(acc, key, kind)))


def luhn_digit(body: Column) -> Column:
    """The check digit that completes a number; other characters do not count."""
    digits = _chars(F.reverse(F.regexp_replace(body, "[^0-9]", "")))
    weighed = F.transform(digits, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
                          .otherwise(c.cast("int")))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN."""
    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.when(digit, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _before_last(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - 1)


#: Issuers and their usual lengths, then other lengths of known issuers; what else passes the check comes last.
_USUAL = r"^(?:4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|6[0-9]{15}|3[47][0-9]{13}|35[0-9]{14}|3[068][0-9]{12})$"
_KNOWN = r"^(?:4(?:[0-9]{12}|[0-9]{18})|[56][0-9]{11,18}|3[068][0-9]{14,17})$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside lambdas an expression is worked out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(tokens: Column) -> Column:
    """The valid cards in a run of digit groups, by their begin: structs (i, k, rank, size), k whole groups after the first i."""
    n = F.size(tokens)

    def span(i: Column, k: Column) -> Column:
        return F.struct(i.alias("i"), k.alias("k"), F.regexp_replace(F.array_join(F.slice(tokens, i + 1, k), ""), "[ -]", "").alias("d"))

    # Groups of three digits and more: six of them make 18 or more, a seventh is too much.
    tidy = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(
        F.transform(F.sequence(F.lit(1), F.least(F.lit(6), n - i)), lambda k: span(i, k)),
        lambda c: F.length(c["d"]).between(13, 19) & F.forall(F.slice(tokens, c["i"] + 1, c["k"]), lambda t: t.rlike("^[0-9]{3}")))))
    # The run itself may have shorter groups; then no tidy span is all of it.
    untidy = (n <= 19) & F.exists(tokens, lambda t: ~t.rlike("^[0-9]{3}"))
    whole = F.when(untidy, F.filter(F.array(span(F.lit(0), n)), lambda c: F.length(c["d"]).between(13, 19)))
    valid = F.filter(F.concat(tidy, F.coalesce(whole, F.array().cast("array<struct<i:int,k:int,d:string>>"))), lambda c: luhn_digit(_before_last(c["d"])) == F.substring(c["d"], -1, 1))
    rank = lambda d: F.when(d.rlike(_USUAL), 1).when(d.rlike(_KNOWN), 2).otherwise(3)
    return F.array_sort(F.transform(valid, lambda c: F.struct(
        c["i"].alias("i"), c["k"].alias("k"), rank(c["d"]).alias("rank"), F.length(c["d"]).alias("size"))))


_SPAN = "struct<i:int,k:int,rank:int,size:int>"
#: Spans whose choices are gathered together, before they join the others.
_TOGETHER = 128


def _chosen(spans: Column) -> Column:
    """Spans that do not overlap, in order: of two neighbours that do, the more usual form, the longer, the earlier stays.

    One sweep: the last span is held until one comes that lies behind it; one that beats it takes its place, and what it had
    beaten comes back if it lies before the new one.
    """
    none, nothing = F.lit(None).cast(_SPAN), F.array().cast(f"array<{_SPAN}>")
    state = lambda out, held, beaten: F.struct(out.alias("out"), held.alias("held"), beaten.alias("beaten"))
    end = lambda c: c["i"] + c["k"]
    better = lambda a, b: (a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["size"] > b["size"]))

    def step(acc: Column, c: Column) -> Column:
        held, beaten = acc["held"], acc["beaten"]
        back = beaten.isNotNull() & (end(beaten) <= c["i"])
        return (F.when(held.isNull(), state(acc["out"], c, none))
                .when(end(held) <= c["i"], state(F.concat(acc["out"], F.array(held)), c, none))
                .when(better(c, held), state(F.when(back, F.concat(acc["out"], F.array(beaten))).otherwise(acc["out"]), c, F.when(back, none).otherwise(held)))
                .otherwise(acc))

    def part(acc: Column, at: Column) -> Column:
        return F.aggregate(F.slice(spans, at, _TOGETHER), state(nothing, acc["held"], acc["beaten"]), step,
                           lambda x: state(F.concat(acc["out"], x["out"]), x["held"], x["beaten"]))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(_TOGETHER)), state(nothing, none, none), part,
                       lambda x: F.concat(x["out"], F.filter(F.array(x["held"]), lambda c: c.isNotNull())))


def _card(m: Column, key: str) -> Column:
    """struct(new, n): the run with its cards replaced, and how many there are; the pieces are joined once."""
    tokens = F.split(m, "(?<=[ -])")

    def one(card: Column) -> Column:
        bare = F.regexp_replace(card, "[ -]+$", "")
        return _let(F.concat(F.substring(bare, 1, 1), permuted(F.substring(bare, F.lit(2), F.length(bare) - 2), key, "card")),
                    lambda body: F.concat(body, luhn_digit(body), F.regexp_extract(card, "[ -]*$", 0)))

    def joined(t: Column, cards: Column) -> Column:
        before = lambda j: F.when(j == 0, F.lit(0)).otherwise(
            F.get(cards, j - 1)["i"] + F.get(cards, j - 1)["k"])
        text = lambda at, n: F.array_join(F.slice(t, at + 1, n), "")
        pieces = F.transform(cards, lambda c, j: F.concat(text(before(j), c["i"] - before(j)), one(text(c["i"], c["k"]))))
        last = before(F.size(cards))
        return F.struct(F.concat(F.array_join(pieces, ""), text(last, F.size(t) - last)).alias("new"), F.size(cards).alias("n"))

    return _let(tokens, lambda t: _let(_spans(t), lambda spans: _let(_chosen(spans), lambda cards: joined(t, cards))))


def _iban(m: Column, key: str) -> Column:
    country, account = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    new = permuted(account, key, "iban")
    valid = iban_digits(country, account) == F.substring(m, 3, 2)
    return F.when(valid, F.concat(country, iban_digits(country, new), new)).otherwise(m)


def _iban_spaced(m: Column, key: str) -> Column:
    return F.regexp_replace(_iban(F.regexp_replace(m, " ", ""), key), "(.{4})(?=.)", "$1 ")


def _address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    pair = lambda i: F.slice(octets, i, 2)

    def step(half: Column, other: Column, k: Column) -> Column:
        return F.transform(half, lambda x, i: ((x + _number(key, "address", k, F.concat_ws("|", i.cast("string"), F.array_join(
            F.transform(other, lambda y: y.cast("string")), ".")))) % 256).cast("int"))

    halves = _feistel(pair(1), pair(3), step)
    new = F.array_join(F.transform(F.concat(halves["l"], halves["r"]), lambda x: x.cast("string")), ".")
    return F.when(F.forall(octets, lambda x: x <= 255), new).otherwise(m)


def _date(m: Column, key: str, form: str = "yyyy-MM-dd") -> Column:
    days = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(_FIRST_DAY).cast("date"))
    inside = days.between(0, _DAYS[0] * _DAYS[1] - 1)
    size = lambda k: F.when(k % 2 == 1, _DAYS[0]).otherwise(_DAYS[1])
    halves = _feistel(F.floor(days / _DAYS[1]).cast("long"), (days % _DAYS[1]).cast("long"),
                      lambda half, other, k: (half + _number(key, "date", k, other)) % size(k))
    moved = F.date_add(F.lit(_FIRST_DAY).cast("date"), (halves["l"] * _DAYS[1] + halves["r"]).cast("int"))
    return F.when(inside, F.date_format(moved, form)).otherwise(m)


def _date_of(m: Column, key: str, forms: list[str]) -> Column:
    """By the first form that the date is valid in; a date of a later form stays one that is invalid in the first."""
    if len(forms) == 1:
        return _date(m, key, forms[0])
    first = lambda x: F.try_to_timestamp(x, F.lit(forms[0])).isNotNull()
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), _date(m, key, forms[1]),
                         lambda acc, _: F.when(first(acc), _date(acc, key, forms[1])).otherwise(acc))
    return F.when(first(m), _date(m, key, forms[0])).otherwise(walked)


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^[A-Za-z_]+\s?[=:]\s?\"?", 0)
    return F.concat(name, permuted(F.substring(m, F.length(name) + 1, F.length(m)), key, "secret"))


def _phone(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 2), _walked(
        F.substring(m, F.lit(3), F.length(m)), key, "phone", r" ?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}"))


def _phone_abroad(m: Column, key: str) -> Column:
    """The country code and a trunk 0 in brackets stay."""
    code = F.regexp_extract(m, r"^\+" + _COUNTRY + r"(?: ?\(0\))?", 0)
    return F.concat(code, permuted(F.substring(m, F.length(code) + 1, F.length(m)), key, "phone"))


def _replaced(m: Column, key: str) -> Column:
    """struct(new, n): the pseudonym of one found value, and how many values that replaces if it differs."""
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    one = lambda new: F.struct(new.alias("new"), F.lit(1).alias("n"))
    return (F.when(whole("email"), one(_email(m, key)))
            .when(whole("secret"), one(_secret(m, key)))
            .when(whole("access_key"), one(F.concat(F.substring(m, 1, 4), permuted(F.substring(m, F.lit(5), F.length(m)), key, "access_key"))))
            .when(whole("iban"), one(_iban(m, key)))
            .when(whole("iban_spaced"), one(_iban_spaced(m, key)))
            .when(whole("phone"), one(_phone(m, key)))
            .when(whole("phone_abroad"), one(_phone_abroad(m, key)))
            .when(whole("phone_local"), one(_walked(m, key, "phone", PHONE_LOCAL)))
            .when(whole("address"), one(_address(m, key)))
            .when(whole("date"), one(_date(m, key)))
            .when(whole("date_slashes"), one(_date_of(m, key, DATES["date_slashes"][1])))
            .when(whole("date_points"), one(_date_of(m, key, DATES["date_points"][1])))
            .when(whole("date_day_first"), one(_date_of(m, key, DATES["date_day_first"][1])))
            .when(whole("ssn"), one(_walked(m, key, "ssn", SSN)))
            .otherwise(_card(m, key)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails its check (or a date beyond 1800 to 2199) stays as it is."""
    return _replaced(m, key)["new"]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced, row by row; no other column changes, whatever its name.

    ``count_col``, if given, holds the number of replaced values (null texts: 0). Texts without values, empty and null
    texts stay as they are. Domains of addresses, country codes, issuer digits and key names stay, as parts of the format.
    """
    text, name = F.col(f"`{text_col}`"), fresh("_pairs", docs.columns)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(m.alias("old"), _replaced(m, key).alias("by")))
    between = F.split(text, PATTERN, -1)
    glue = F.transform(F.arrays_zip(between.alias("gap"), F.col(name).alias("pair")),
                       lambda z: F.concat(z["gap"], F.coalesce(z["pair"]["by"]["new"], F.lit(""))))
    has = text.isNotNull() & text.rlike(PATTERN)
    step = docs.withColumn(name, F.when(has, pairs))
    new = F.when(F.col(name).isNotNull(), F.array_join(glue, "")).otherwise(text).alias(text_col)
    out = [new if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    if count_col:
        changed = F.aggregate(F.filter(F.col(name), lambda p: p["old"] != p["by"]["new"]), F.lit(0), lambda a, p: a + p["by"]["n"])
        out.append(F.coalesce(F.when(F.col(name).isNotNull(), changed), F.lit(0)).alias(count_col))
    return step.select(*out)
