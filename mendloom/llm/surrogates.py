"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities keep their type and punctuation, names also their script (Latin, Cyrillic, Greek), capitals, hyphens and,
if listed, gender; equal entities, also
in different spellings of one number or address, get equal surrogates in all documents, different ones
different surrogates, none of which is an entity of the corpus. Surrogates are drawn from a keyed hash;
listed given names follow one another in a keyed order of their list, which is short, so who knows some
pairs can guess others.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendloom.llm.common import materialise

#: Given names by gender and script: recognised in texts, and replaced by others of the same list.
GIVEN = {
    "female latin": "Mary Anna Maria Emma Laura Julia Sarah Lucia Sofia Elena Claire Marie Louise Greta Ingrid Carmen",
    "male latin": "John Peter Paul Thomas Michael David James Robert Carlos Pablo Hans Karl Pierre Louis Antoine Miguel",
    "female cyrillic": "Анна Мария Елена Ольга Ирина Татьяна Наталья Светлана",
    "male cyrillic": "Иван Пётр Павел Сергей Алексей Дмитрий Михаил Николай",
}
#: Titles that announce a name.
TITLES = "Mr|Mrs|Ms|Miss|Mx|Sir|Dr|Dra|Doctor|Doktor|Docteur|Prof|Professor|Herr|Herrn|Frau|Fräulein|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señora|Señor|Señorita|Srta|Sra|Sr|Don|Doña|господин|госпожа|доктор|профессор"
#: Syllables of made-up names, by the script of the word that they replace; the last holds for all others.
SYLLABLES = {
    r"\p{IsCyrillic}": "ба бе бо ва ве го да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ви",
    r"\p{IsGreek}": "βα βε γα γο δα δε θα κα κε κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε τα τε το φα",
    "": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va",
}
_NAME = r"\p{Lu}[\p{L}'’-]+"
_MORE = rf"(?: (?:(?:von|van|zu|de|da|do|di|du|del|der|den|la|le) ){{0,2}}{_NAME})"
#: Names by what stands before them: salutations, introductions, ends of letters. The words stay, as titles do.
_SALUTES = "Dear|Liebe|Lieber|Cher|Chère|Estimado|Estimada|Querido|Querida"
_NOBODY = "Customer|Sir|Madam|All|Friend|Friends|Team|Colleague|Colleagues|Reader|Readers|Editor|Members?|Parents?|Students?"
_CUES = r"(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут) |(?:[Rr]egards|[Ss]incerely|[Yy]ours|[Gg]rüßen|[Cc]ordialement|[Ss]aludos),\s{1,3}"
_SALUTED = rf"(?=[DLCEQ])\b(?:{_SALUTES}) (?!(?:{TITLES}|{_NOBODY})\b){_NAME}{_MORE}{{0,2}}(?=[,:!\n])"
_CUED = rf"(?=[MmIiJjRrSsYyGgCcМм])\b(?:{_CUES}){_NAME}{_MORE}{{0,2}}"
_SECRET = r"(?i:(?:pass(?:word|wd)|token|secret|a(?:pi|ccess)[_-]?key)[A-Za-z0-9_-]{0,64}+)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: A secret follows an equals sign, or the colon of a quoted key and a quoted value, or has a digit; it ends at its closing quote or at white space.
_PLAIN = r"(?<==\s{0,3}[\"']?)|(?<=[\"']\s{0,3}:\s{0,3}[\"'])"
_QUOTED = "|".join(rf"(?<={q})(?:{_PLAIN}|(?=[^{q}\n]*?[0-9]))[^{q}\n]{{6,}}+(?={q}|$)" for q in ('"', "'"))
_VALUE = rf"(?:{_QUOTED}|(?:{_PLAIN}|(?=[^\s\"']*?[0-9]))[^\s\"']{{5,}}[^\s\"'`,;.:!?)\]}}>])"
#: Secrets by their own form: keys that begin with ``sk``, and signed tokens of three parts.
_KEYED = r"(?=[se])\b(?:sk[_-](?:[a-z]{1,12}[_-]){0,2}[A-Za-z0-9]{16,256}+|eyJ[A-Za-z0-9_-]{8,4096}+\.eyJ[A-Za-z0-9_-]{4,4096}+\.[A-Za-z0-9_-]{8,4096}+)"
_TITLED = rf"(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}])\b(?:(?:{TITLES})\.? ){{1,3}}(?:(?:von|van|zu|de|da|do|di|du|del|der|den|la|le) ){{0,2}}{_NAME}{_MORE}{{0,2}}"
_LISTED = rf"(?=[{''.join(sorted({n[0] for n in ' '.join(GIVEN.values()).split()}))}])(?<!\p{{L}})(?:{'|'.join(' '.join(GIVEN.values()).split())}){_MORE}{{1,2}}"
#: Country codes of telephones by their length: fixed values of the international plan.
COUNTRIES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: International numbers (after + or 00), area codes in brackets, ten digits, national numbers in pairs, after an area code, in one piece, and Spanish ones.
_PHONES = (
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d{2,4}|\d(?=(?:[ .-]?\d){6}))(?:[ .-]?\d{2,4}){1,4}(?!\w)",
    r"00[1-9]\d{0,2}[ .-](?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)",
    r"\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\w)",
    r"\(0\d{1,5}\) ?\d{3,8}(?:[ /-]\d{2,8}){0,3}(?![\w-])",
    r"(?<![/-])(?:\d{3}[ .-]\d{3}[ .-]\d{4}|0[1-9](?:[ .-]\d{2}){4}|0[1-9](?=(?:[ /-]?\d){6})\d{1,3}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,3}|0[1-9]\d{8,9}|[6-9]\d\d(?: \d\d){3}|9\d \d{3} \d\d \d\d)(?![\w-])",
)
#: Patterns by type, in order of precedence; each finds whole entities and can't run over a long text twice.
#: They begin with a look at one character, which settles almost every place of a text.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": rf"(?=[PpTtSsAa]){_SECRET}{_VALUE}|\bAKIA[0-9A-Z]{{16}}\b|\bgh[pousr]_[A-Za-z0-9]{{36,}}+|{_KEYED}",
    "ip": r"(?=[0-9])(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "iban": r"(?=[A-Z])\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?=[0-9])(?<![\w.-])(?:\d{13,19}|[3-6]\d{3}(?:[ -]\d{4}){2}[ -]\d{1,4}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "ssn": r"(?=[0-9])(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": rf"(?=[+(0-9])(?<![\w.])(?:{'|'.join(_PHONES)})",
    "name": f"{_TITLED}|{_LISTED}|{_SALUTED}|{_CUED}",
}
#: Only a secret begins inside an ASCII word, so there the other patterns aren't tried.
ANY = rf"(?<![A-Za-z])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})|{PATTERNS['secret']}"
_HEADS = {"secret": rf"^(?:{_SECRET}|sk[_-](?:[a-z]{{1,12}}[_-]){{0,2}}|eyJ)", "phone": rf"^(?:(?:\+|00)(?:{COUNTRIES})[ .-]?|\(?0)", "name": rf"^(?:(?:(?:{TITLES})\.? ){{1,3}}|(?:{_SALUTES}) |{_CUES})"}


def has_entity(text: Column) -> Column:
    """Whether any pattern matches; texts without a sign, a number or a name that all patterns need are settled cheaply."""
    sign = F.contains(text, F.lit("@")) | F.rlike(text, F.lit(r"[0-9]\.?[0-9]|AKIA|gh[pousr]_|\bsk[_-]|\beyJ")) | F.rlike(text, F.lit(_TITLED)) | F.rlike(text, F.lit(_LISTED)) | F.contains(text, F.lit("::")) | F.rlike(text, F.lit(rf"\b(?:{_SALUTES}) |{_CUES}"))
    word = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.rlike(text, F.lit(f"(?=[PpTtSsAa]){_SECRET}"))
    return F.coalesce((sign | word) & F.rlike(text, F.lit(ANY)), F.lit(False))


def kind_of(found: Column) -> Column:
    """Type of an entity: the first pattern that it matches whole; names known by what stands around them match none."""
    return F.coalesce(*(F.when(F.rlike(found, F.lit(rf"^(?:{p})$")), F.lit(k)) for k, p in PATTERNS.items()), F.lit("name"))


def head_of(found: Column, kind: Column) -> Column:
    """What stays of an entity: titles, a country code or leading 0, the word before a secret."""
    return reduce(lambda rest, k: F.when(kind == k, F.regexp_extract(found, _HEADS[k], 0)).otherwise(rest), _HEADS, F.lit(""))


def _stream(key: str, kind: Column, core: Column, attempt: Column) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, core, attempt.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))


def _draw(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(stream: Column, i: Column, chars: str) -> Column:
    return F.substr(F.lit(chars), F.pmod(_draw(stream, i), F.lit(len(chars))) + 1, F.lit(1))


def _spell(text: Column, stream: Column) -> Column:
    """Every digit and letter replaced by one of its own kind, characters beyond ASCII by small letters; all else stays."""
    ranges = (("0", "9", "0123456789"), ("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    one = lambda c, i: reduce(lambda rest, r: F.when((c >= r[0]) & (c <= r[1]), _pick(stream, i, r[2])).otherwise(rest), ranges, F.when(c > "\x7f", _pick(stream, i, ranges[1][2])).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _by_digit(text: Column, stream: Column) -> Column:
    """Every digit replaced, the nth by the nth draw, so one number in two spellings stays one number; letters likewise."""
    nth = lambda i: F.length(F.regexp_replace(F.substr(text, F.lit(1), i + 1), r"[^0-9A-Za-z]", "")) - 1
    ranges = (("0", "9", "0123456789"), ("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    one = lambda c, i: reduce(lambda rest, r: F.when((c >= r[0]) & (c <= r[1]), _pick(stream, nth(i), r[2])).otherwise(rest), ranges, c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex(text: Column, stream: Column) -> Column:
    """Every hexadecimal digit replaced, none by 0; case stays."""
    one = lambda c, i: F.when(F.rlike(c, F.lit("[0-9a-f]")), _pick(stream, i, "123456789abcdef")).when(F.rlike(c, F.lit("[A-F]")), _pick(stream, i, "123456789ABCDEF")).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _iban(core: Column, stream: Column) -> Column:
    """Country and form stay, the rest is drawn anew, and the check digits fit it."""

    def checked(e: Column) -> Column:
        value = lambda c: F.when((c >= "0") & (c <= "9"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)
        signs = F.split(F.concat(F.regexp_replace(e["rest"], " ", ""), e["country"], F.lit("00")), "")
        left = F.aggregate(signs, F.lit(0), lambda acc, c: F.pmod(F.when(value(c) < 10, acc * 10).otherwise(acc * 100) + value(c), F.lit(97)))
        return F.concat(e["country"], F.lpad((98 - left).cast("string"), 2, "0"), e["rest"])

    drawn = F.struct(F.substr(core, F.lit(1), F.lit(2)).alias("country"), _by_digit(F.substr(core, F.lit(5)), stream).alias("rest"))
    return F.transform(F.array(drawn), checked)[0]


def canonical(kind: Column, core: Column) -> Column:
    """What all spellings of an entity share: digits of numbers, small letters of addresses, names with capitals at the beginnings of words."""
    name = F.array_join(F.transform(F.split(core, " "), lambda w: F.when(F.rlike(w, F.lit(r"^\p{Ll}")), w).otherwise(F.initcap(w))), " ")
    digits = F.regexp_replace(core, r"\D", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind.isin("email", "ipv6"), F.lower(core)).when(kind == "iban", F.upper(F.regexp_replace(core, " ", ""))).when(kind == "name", name).otherwise(core)


def _email(core: Column, stream: Column, key: str) -> Column:
    """Local part by the whole address, domain by the domain alone, under the reserved top level ``example``."""
    domain = F.substring_index(core, "@", -1)
    seeded = F.transform(F.array(domain), lambda d: F.struct(d.alias("domain"), _stream(key, F.lit("domain"), F.lower(d), F.lit(0)).alias("stream")))
    spelt = F.transform(seeded, lambda d: _spell(F.regexp_replace(d["domain"], r"\.[^.]*$", ""), d["stream"]))
    return F.concat(_spell(F.substring_index(core, "@", 1), stream), F.lit("@"), spelt[0], F.lit(".example"))


def _card(core: Column, stream: Column) -> Column:
    """Digits anew; a number that passes the Luhn check gets a last digit with which it passes again."""
    sound = lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"\D", ""))
    stems = F.transform(F.array(_by_digit(core, stream)), lambda x: F.struct(x.alias("all"), F.substr(x, F.lit(1), F.length(x) - 1).alias("stem")))
    ending = lambda x: F.filter(F.array(*(F.concat(x["stem"], F.lit(str(d))) for d in range(10))), sound)[0]
    return F.transform(stems, lambda x: F.when(sound(core), ending(x)).otherwise(x["all"]))[0]


def _name(core: Column, attempt: Column, key: str) -> Column:
    """Listed given names become others of their gender and script, in a keyed order; other parts made-up words of the same script.

    Hyphens and apostrophes stay, as do initials' length and capitals throughout; small words (``von``) stay whole.
    """

    def made_up(p: Column, piece: Column, i: Column) -> Column:
        made = F.lit(None).cast("string")
        for script, syllables in SYLLABLES.items():
            listed = F.array(*(F.lit(s) for s in syllables.split()))
            word = F.initcap(F.concat(*(F.get(listed, F.pmod(_draw(p["stream"], i * 4 + j), F.lit(len(syllables.split())))) for j in range(4))))
            made = F.coalesce(made, F.when(F.rlike(piece, F.lit(script)), word))
        made = F.when(F.length(piece) == 1, F.substr(made, F.lit(1), F.lit(1))).otherwise(made)
        return F.when(F.rlike(piece, F.lit(r"^\p{L}")), made).otherwise(piece)

    def part(p: Column) -> Column:
        made = F.array_join(F.transform(F.split(p["word"], r"(?=['’-])|(?<=['’-])"), lambda piece, i: made_up(p, piece, i)), "")
        for names in GIVEN.values():
            order = sorted(names.split(), key=lambda x: hashlib.sha256(f"{key}\x1f{x}".encode()).digest())
            listed, n = F.array(*(F.lit(x) for x in order)), len(order)
            place = F.array_position(listed, F.initcap(p["word"])).cast("int")
            made = F.when(place > 0, F.get(listed, F.pmod(place + F.pmod(attempt, F.lit(n - 1)), F.lit(n)))).otherwise(made)
        return F.struct(p["word"].alias("word"), made.alias("made"))

    cased = lambda p: F.when(F.rlike(p["word"], F.lit(r"^\p{Ll}")), p["word"]).otherwise(_like(p["word"], p["made"]))
    seeded = F.transform(F.split(core, " "), lambda w: F.struct(w.alias("word"), _stream(key, F.lit("name"), F.initcap(w), attempt).alias("stream")))
    return F.array_join(F.transform(F.transform(seeded, part), cased), " ")


def _like(word: Column, made: Column) -> Column:
    """``made`` in capitals throughout if ``word`` is."""
    return F.when(F.rlike(word, F.lit(r"^[\p{Lu}'’-]{2,}$")), F.upper(made)).otherwise(made)


def _surrogate(kind: Column, core: Column, attempt: Column, stream: Column, key: str) -> Column:
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_draw(stream, i), F.lit(254)) + 1).cast("string")), ".")
    chosen = F.when(kind == "email", _email(core, stream, key)).when(kind == "ip", octets).when(kind == "iban", _iban(core, stream)).when(kind.isin("phone", "ssn"), _by_digit(core, stream)).when(kind == "ipv6", _hex(core, stream)).when(kind == "card", _card(core, stream)).when(kind == "name", _name(core, attempt, key)).otherwise(_spell(core, stream))
    return F.when(attempt < 8, chosen).otherwise(F.concat(chosen, F.substr(stream, F.lit(1), F.lit(12))))


def surrogates(parts: Column, key: str) -> Column:
    """Replacements of an array of (head, kind, core, attempt); from the eighth attempt on they are also longer, so some attempt is free."""
    seeded = F.transform(parts, lambda e: F.struct(e["head"].alias("head"), e["kind"].alias("kind"), e["core"].alias("core"), e["attempt"].alias("attempt"), _stream(key, e["kind"], canonical(e["kind"], e["core"]), e["attempt"]).alias("stream")))
    return F.transform(seeded, lambda e: F.concat(e["head"], _surrogate(e["kind"], e["core"], e["attempt"], e["stream"], key)))


def parts(found: Column) -> Column:
    """(head, kind, core) of each of an array of entities: one step after the other, so that each is done once."""
    kinds = F.transform(found, lambda f: F.struct(f.alias("found"), kind_of(f).alias("kind")))
    heads = F.transform(kinds, lambda e: F.struct(e["found"].alias("found"), e["kind"].alias("kind"), head_of(e["found"], e["kind"]).alias("head")))
    return F.transform(heads, lambda e: F.struct(e["head"].alias("head"), e["kind"].alias("kind"), F.substr(e["found"], F.length(e["head"]) + 1).alias("core")))


def entities(docs: DataFrame, column: str = "text") -> DataFrame:
    """(kind, core) of every distinct entity of all documents, ``core`` in the form that its spellings share."""
    text = F.col(column)
    found = docs.where(has_entity(text)).select(F.explode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found")).distinct()
    return found.select(F.explode(parts(F.array("found"))).alias("p")).select("p.kind", canonical(F.col("p.kind"), F.col("p.core")).alias("core")).distinct()


def retried(found: DataFrame, key: str) -> DataFrame:
    """(kind, core, attempt) of entities whose first surrogate is taken by another entity or is one itself.

    Of entities with one surrogate the least keeps it. Rounds go on until all surrogates differ.
    """
    known = materialise(found.withColumn("attempt", F.lit(0)), "entities")
    while True:
        given = surrogates(F.array(F.struct(F.lit("").alias("head"), "kind", "core", "attempt")), key)[0]
        named = known.withColumn("given", canonical(F.col("kind"), given))
        nth = F.row_number().over(Window.partitionBy("kind", "given").orderBy("attempt", "core"))
        real = known.select(F.col("kind").alias("k"), F.col("core").alias("real"))
        hit = named.withColumn("nth", nth).join(real, (F.col("kind") == F.col("k")) & (F.col("given") == F.col("real")), "left")
        again = hit.select("kind", "core", "attempt", ((F.col("nth") > 1) | F.col("real").isNotNull()).alias("clash"))
        again = materialise(again, "attempts")
        if again.where("clash").isEmpty():
            return known.where("attempt > 0")
        known = materialise(again.select("kind", "core", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")), "entities")


def _mentions(gap: Column, known: Column) -> Column:
    """Text between entities, with parts of the document's own names replaced by the surrogates of those parts.

    ``known`` is a map from parts to surrogates; null or empty leaves the text alone. A part is found in
    other capitals too, if it begins with one.
    """
    words = F.array_join(F.map_keys(known), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?=\p{Lu})(?iu:"), words, F.lit(r")(?![\p{L}\p{N}_])"))
    hits = F.regexp_extract_all(gap, pattern, F.lit(0))
    swapped = F.array_join(F.zip_with(F.split(gap, pattern, -1), hits, lambda g, h: F.concat(g, F.coalesce(_like(h, F.element_at(known, F.initcap(h))), h, F.lit("")))), "")
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, swapped).otherwise(gap)


def _parts_of_names(tried: Column, key: str) -> Column:
    """Map from the words of the names found in a document to their surrogates; of two attempts the first counts."""
    named = F.filter(tried, lambda e: e["kind"] == "name")
    words = F.flatten(F.transform(named, lambda e: F.transform(F.filter(F.split(e["core"], " "), lambda w: F.rlike(w, F.lit(r"^\p{Lu}[\p{L}'’-]{2,}$"))), lambda w: F.struct(F.initcap(w).alias("word"), e["attempt"].alias("attempt")))))
    first = F.filter(words, lambda w, i: F.array_position(F.transform(words, lambda x: x["word"]), w["word"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda w: F.struct(w["word"].alias("key"), _name(w["word"], w["attempt"], key).alias("value"))))


def replace_entities(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with every entity in ``column`` replaced, and ``entities``: how many were.

    Where a name was found, its parts are replaced wherever else they stand in that document. Null texts
    stay null with 0 entities; texts without entities stay as they are, byte for byte.
    Repeated rows and ties are treated alike. Rows aren't shuffled, unless many surrogates clash: documents are joined by
    a hash of their text with the attempts of their clashing entities, a table that is written first, so
    Spark broadcasts it if its files are under ``spark.sql.autoBroadcastJoinThreshold``. The result may be
    used in Python functions.
    Columns named ``entities`` are replaced; names that begin with ``surrogate_`` are the operator's own.
    """
    text = F.col(column)
    odd = retried(entities(docs, column), key)
    tries = F.lit(None).cast("map<string,int>")
    if not odd.isEmpty():
        found = docs.where(has_entity(text)).select(F.sha2(text, 256).alias("hash"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).alias("found")).distinct()
        named = found.select("hash", F.explode(parts(F.array("found"))).alias("p")).select("hash", "p.kind", canonical(F.col("p.kind"), F.col("p.core")).alias("core")).distinct()
        of_text = named.join(odd, ["kind", "core"]).groupBy(F.col("hash").alias("surrogate_hash_")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "core"), "attempt"))).alias("surrogate_tries_"))
        docs = docs.join(materialise(of_text, "clashes"), F.sha2(text, 256) == F.col("surrogate_hash_"), "left").drop("surrogate_hash_")
        tries = F.col("surrogate_tries_")

    attempt = lambda e: F.coalesce(F.element_at(tries, F.concat_ws("\x1f", e["kind"], canonical(e["kind"], e["core"]))), F.lit(0))

    def rebuilt(e: Column) -> Column:
        known = F.transform(F.array(_parts_of_names(e["tried"], key)), lambda known: F.transform(e["gaps"], lambda g: _mentions(g, known)))[0]
        joined = F.array_join(F.zip_with(known, surrogates(e["tried"], key), lambda g, new: F.concat(g, F.coalesce(new, F.lit("")))), "")
        return F.struct(joined.alias("text"), F.size(e["tried"]).cast("long").alias("entities"))

    # One step after the other, so that the patterns run over a text once for its entities and once for what is between.
    tried = F.transform(parts(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), lambda e: F.struct(e["head"].alias("head"), e["kind"].alias("kind"), e["core"].alias("core"), attempt(e).alias("attempt")))
    whole = F.transform(F.array(F.struct(tried.alias("tried"), F.split(text, ANY, -1).alias("gaps"))), rebuilt)[0]
    # Exploding an array of one keeps the expression out of later functions' arguments, where Spark can't plan it.
    out = docs.select("*", F.explode(F.array(F.when(has_entity(text), whole))).alias("surrogate_new_"))
    out = out.withColumns({"entities": F.coalesce("surrogate_new_.entities", F.lit(0)).cast("long"), column: F.coalesce("surrogate_new_.text", text)})
    return out.drop("surrogate_tries_", "surrogate_new_")
