"""Personal data replaced by keyed surrogates, in DataFrame functions only.

E-mail addresses, secrets (long hexadecimal keys, keys with a known prefix, long mixtures of digits and both cases),
IBANs, IPv4 and IPv6 addresses, phone numbers (international, North American, national with a leading zero),
social-security and payment-card numbers, and names (after a form of address or a phrase that announces one, or with a
well-known given name) are found by one expression that never backtracks over a long run. A
surrogate is a function of a key, the entity's type and its canonical form (lower case, digits without separators
country code or trunk zero; mixed keys as written), so every mention of an entity, however written, gets the same one: coreference holds across all
documents and no text has to move. It keeps the mention's format: separators, digits as digits, letters in their
case and script, octets in range, a card's check digit if it had one, a name's gender. A surname is an entity of its own: alone
("Mr Smith") or after a given name ("Mr John Smith") it is replaced alike, so a short mention still points to the long one.

Collisions are looked for over all distinct entities: where two have one surrogate, or a surrogate is itself an
entity of the documents, all but the least draw again, until none is left. The few that drew again are joined to
the documents that mention them; if there are none, nothing is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import stored

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Forms of address, by gender; then given names, by gender and script. Fixed values.
MALE, FEMALE, ANY = r"Mr|Herr|Señor|Sr|Monsieur|господин|г-н", r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа|г-жа", r"Dr|Prof"
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Marc", "Oscar", "Paul", "Simon", "Theo", "Victor"],
    ("latin", "f"): ["Ada", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Rosa", "Sara"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"],
    ("cyrillic", "f"): ["Алла", "Вера", "Дарья", "Елена", "Жанна", "Ирина", "Лидия", "Нина"],
}
SYLLABLES = {"latin": "ba be bo da do fa ga ka ko la le lo ma mi na no ra ri sa ta to va ve wi".split(), "cyrillic": "ба бе бо ва во га да до за ка ко ла ле ло ма ми на но ра ри са та то фа".split()}
#: Given names that announce a name by themselves, beside those above. Fixed values.
WELL_KNOWN = {
    "m": "Alexander Andrew Anthony Benjamin Brian Charles Christopher Daniel Donald Edward Eric Frank Gary George Gregory Hans Henry Jacob James Jason Jeffrey John Jonathan Joseph Joshua Juan Kenneth Kevin Klaus Larry Luca Luis Matthew Michael Nicholas Patrick Peter Pierre Richard Robert Ronald Ryan Samuel Scott Stefan Stephen Steven Thomas Timothy William Wolfgang Александр Андрей Дмитрий Иван Михаил Николай Павел Сергей".split(),
    "f": "Alice Amanda Amy Angela Anna Barbara Betty Brenda Carol Catherine Christine Cynthia Deborah Donna Dorothy Elizabeth Emily Heather Jane Janet Jennifer Jessica Karen Katherine Kathleen Kimberly Linda Lisa Margaret Marie Martha Mary Melissa Michelle Nancy Nicole Pamela Patricia Rachel Rebecca Ruth Sandra Sarah Sharon Sophie Stephanie Susan Teresa Ursula Анна Екатерина Мария Наталья Ольга Светлана Татьяна".split(),
}
#: Phrases that announce a whole name. Fixed values.
ANNOUNCED = r"[Mm]y name is|[Ii]ch heiße|[Jj]e m’appelle|[Mm]e llamo|[Мм]еня зовут|[Ss]igned(?: by)?:?|[Ww]ritten by|[Ss]incerely,|[Rr]egards,"
_NAME = r"\p{Lu}[\p{L}'’-]++"
_KNOWN = "|".join(sorted({n for names in GIVEN.values() for n in names} | {n for names in WELL_KNOWN.values() for n in names}))
_TITLE = rf"(?:{MALE}|{FEMALE}|{ANY})\.?"
#: What may stand before a name as part of its mention.
_BEFORE = rf"(?:{_TITLE}|{ANNOUNCED}) "
_PREFIX = r"(?:AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[spr]k[-_](?:(?:live|test|proj)[-_])?)"
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "SECRET": _B + r"(?=[a-fA-F]{0,31}[0-9])[0-9a-fA-F]{32,}+" + _E,
    # forms with hyphens begin where their run begins, so no run is gone through more than once
    "KEY": _B + r"(?:(?<![_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|github_pat_|glpat-|[spr]k[-_](?:(?:live|test|proj)[-_])?)(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{16,}+|AIza[A-Za-z0-9_-]{35}"
    + r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)|(?=(?:[A-Za-z]*+[0-9]){3})(?=[0-9a-z]*+[A-Z])(?=[0-9A-Z]*+[a-z])[A-Za-z0-9]{24,}+)" + _E,
    "IBAN": _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "IP": _B + r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])" + _E,
    "IP6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,39}[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![\p{L}\p{N}:])",
    "PHONE": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    + r"|0[0-9](?:[ .][0-9]{2}){4}|(?=(?:[()/ -]{0,2}[0-9]){9,13}(?![0-9]))\(?0(?:0[0-9]{1,3} [0-9]{2,5}|[0-9]{2,5})\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,3})" + _E,
    "CARD": _B + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})" + _E,
    "SSN": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E,
    "NAME": _B + rf"(?:{_TITLE} {_NAME}(?: {_NAME})?|(?:{ANNOUNCED}) (?!{_TITLE} ){_NAME} {_NAME}|(?=\p{{Lu}})(?:{_KNOWN}) {_NAME})",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any of the patterns needs: a text without it is passed by at once.
_QUICK = rf"[0-9@]|{_BEFORE}\p{{Lu}}|(?=\p{{Lu}})(?:{_KNOWN}) \p{{Lu}}"


def let(value, body):
    """``body(value)`` with the value computed once and named: expressions stay as small as they are written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(m):
    """The type of a mention that the expression found."""
    out = F.lit("NAME")
    for name in ("SSN", "CARD", "PHONE", "IP6", "IP", "IBAN", "KEY", "SECRET", "EMAIL"):
        out = F.when(m.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _form(m, k):
    digits = F.regexp_replace(F.regexp_replace(m, r"^(?:\+|00)[0-9]{1,3}(?=[^0-9])", ""), r"[^0-9]", "")
    form = F.when(k == "PHONE", F.regexp_replace(digits, "^0", "")).when(k.isin("CARD", "SSN"), digits).when(k == "KEY", m).when(k == "IBAN", F.regexp_replace(m, " ", ""))
    return form.when(k == "NAME", F.regexp_replace(m, rf"^{_BEFORE}", "")).otherwise(F.lower(m))


def canonical(m):
    """Type and canonical form: equal for all mentions of one entity."""
    return let(m, lambda m: let(kind(m), lambda k: F.concat_ws(":", k, _form(m, k))))


def _bytes(key: str, what, attempt):
    """64 keyed numbers from 0 to 255."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), what, attempt.cast("string")), 512)
    return let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


#: Letters of the scripts but Latin, from which a letter's replacement comes; equal for both cases.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфх", "Greek": "αβγδεζηθικλμνξοπρτυφχψω", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ", "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조", "Han": "山川田木林森水火土石金竹花草米麦東西南北"}


def _at(numbers, i):
    return F.get(numbers, i % 64)


def _shaped(m, numbers, keep=0, letters: int = 26):
    """Each letter or digit after the first ``keep`` of them changed for another of its class; the rest as written."""

    def step(acc, c):
        x = _at(numbers, acc["i"])
        new = F.when(c.between("0", "9"), (x % 10).cast("string"))
        for script, alphabet in ALPHABETS.items():
            new = new.when(c.rlike(rf"^\p{{Is{script}}}$"), F.substring(F.lit(alphabet), 1 + x % len(alphabet), F.lit(1)))
        new = new.when(c.rlike(r"^\p{L}$"), F.char(97 + x % letters))
        new = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)
        return let(F.when(acc["i"] >= keep, new), lambda n: F.struct(F.concat(acc["out"], F.coalesce(n, c)).alias("out"), (acc["i"] + F.when(n.isNotNull() | c.rlike(r"^[\p{L}0-9]$"), 1).otherwise(0)).alias("i")))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: acc["out"])


def _luhn(digits, shift: int):
    """Luhn sum of a string of digits whose last one counts once (shift 0) or twice (shift 1)."""

    def add(acc, c):
        d = c.cast("int") * F.when((acc["i"] + shift) % 2 == 1, 2).otherwise(1)
        return F.struct((acc["s"] + d - F.when(d > 9, 9).otherwise(0)).alias("s"), (acc["i"] + 1).alias("i"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), add, lambda acc: acc["s"])


def _less(m, n: int = 1):
    return F.substring(m, F.lit(1), F.length(m) - n)


def _email(m, numbers, attempt, key: str):
    """The domain is an entity of its own, so addresses of one domain stay together; its last part is a reserved one."""
    reserved = r"(?:^|\.)(example\.(?:com|org|net))$"

    def domain(d):
        suffix = F.regexp_extract(d, reserved, 1)
        host = F.regexp_replace(d, r"(?:^|\.)(?:example\.(?:com|org|net)|[^.]+)$", "")
        moved = let(_bytes(key, F.concat(F.lit("DOMAIN:"), d), F.lit(0)), lambda x: _shaped(host, x))
        return F.concat(moved, F.when(host == "", "").otherwise("."), F.when(suffix == "", "example").otherwise(suffix))

    # a form with few surrogates gets longer as draws collide
    longer = F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.char(97 + _at(numbers, 40 + i) % 26)), "")
    return F.concat(_shaped(F.substring_index(m, "@", 1), numbers), F.when(attempt > 0, longer).otherwise(""), F.lit("@"), let(F.lower(F.substring_index(m, "@", -1)), domain))


def _ip(m, numbers, attempt):
    """Octets of the lengths they had; after some draws that collided, of any."""
    octet = lambda o, i: F.when(F.length(o) == 1, _at(numbers, i) % 10).when(F.length(o) == 2, 10 + _at(numbers, i) % 90).otherwise(100 + _at(numbers, i) % 156)
    new = lambda o, i: F.when(attempt > 3, _at(numbers, i)).otherwise(octet(o, i)).cast("string")
    return F.array_join(F.transform(F.split(m, r"\."), new), ".")


def _iban(m, numbers):
    """The country stays; the check digits are right for what follows."""

    def checked(x):
        flat = F.replace(x, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 2), F.lit("00"))
        step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        check = 98 - F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
        return F.concat(F.substring(x, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(x, F.lit(5), F.length(x)))

    return let(_shaped(m, numbers, 4), checked)


def _phone(m, numbers):
    """The country code and a leading zero stay."""
    return let(F.regexp_extract(m, r"^(?:(?:\+|00)[0-9]{1,3}(?=[^0-9])[ .-]?)?\(?0?\)?", 0), lambda code: F.concat(code, _shaped(F.substring(m, F.length(code) + 1, F.length(m)), numbers)))


def _key(m, numbers):
    """A known prefix stays."""
    return let(F.regexp_extract(m, rf"^{_PREFIX}?", 0), lambda prefix: F.concat(prefix, _shaped(F.substring(m, F.length(prefix) + 1, F.length(m)), numbers)))


def _card(m, numbers):
    """A number with a right check digit gets a right one."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")

    def checked(c):
        check = (10 - _luhn(_less(digits(c)), 1) % 10) % 10
        return F.when(_luhn(digits(m), 0) % 10 == 0, F.concat(_less(c), check.cast("string"))).otherwise(c)

    return let(_shaped(m, numbers), checked)


#: A given name and a surname in a canonical form, and what goes to leave the surname.
_FULL, _FIRST = r"^NAME:[^ ]+ [^ ]+$", rf"({_BEFORE})?[^ ]+ ([^ ]+)"


def surname(entity):
    """The canonical form of a whole name's surname; null for any other entity."""
    return F.when(entity.rlike(_FULL), F.concat(F.lit("NAME:"), F.substring_index(entity, " ", -1)))


def _name(m, numbers, attempt, family, key: str):
    """What stands before the name stays; two words get a given name by gender and script, the last one becomes syllables.

    The syllables come from the last word alone, as often drawn as ``family`` says where another word stands before it.
    """
    of = lambda names, x: F.get(F.array(*map(F.lit, names)), x % len(names))
    script = lambda word, make: F.when(word.rlike(r"^\p{IsCyrillic}"), make("cyrillic")).otherwise(make("latin"))

    def named(p):
        address, words = p["address"], p["words"]
        word, final = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
        known = lambda sex: word.isin(*(n for (_, g), names in GIVEN.items() if g == sex for n in names), *WELL_KNOWN[sex])
        # where no address tells: a listed name, or the ending of most given names of women
        likely = known("f") | (word.rlike(r"(?:a|ah|ie|ine|elle|ette|а|я)$") & (F.size(words) > 1) & ~known("m"))
        female = address.rlike(rf"^(?:{FEMALE})\.? $") | (~address.rlike(rf"^(?:{MALE})\.? $") & likely)
        given = lambda i: script(word, lambda s: F.when(female, of(GIVEN[s, "f"], _at(numbers, i))).otherwise(of(GIVEN[s, "m"], _at(numbers, i))))
        # a given name gets a further part with every draw that collided
        first = F.array_join(F.transform(F.sequence(F.lit(0), attempt), given), "-")
        # a surname alone is its own entity, so either way its draws are keyed by it
        draws = F.when(F.size(words) > 1, family).otherwise(attempt)
        syllables = lambda x: F.transform(F.sequence(F.lit(1), 4 + draws), lambda i: script(final, lambda s: of(SYLLABLES[s], _at(x, i))))
        last = let(_bytes(key, F.concat(F.lit("NAME:"), final), draws), lambda x: F.initcap(F.array_join(syllables(x), "")))
        return F.concat(address, F.when(F.size(words) > 1, F.concat(first, F.lit(" "))).otherwise(""), last)

    def parted(address):
        return let(F.struct(address.alias("address"), F.split(F.substring(m, F.length(address) + 1, F.length(m)), " ").alias("words")), named)

    return let(F.regexp_extract(m, rf"^(?:{_BEFORE})?", 0), parted)


def surrogate(m, attempt, family, key: str):
    """The replacement of a mention; ``attempt`` counts the draws of its entity that collided, ``family`` those of a whole name's surname."""

    def drawn(m, k, numbers):
        upper = (m == F.upper(m)) & m.rlike("[A-Z]")
        return (
            F.when(k == "EMAIL", let(_email(m, numbers, attempt, key), lambda x: F.when(upper, F.upper(x)).otherwise(x))).when(k.isin("SECRET", "IP6"), _shaped(m, numbers, 0, 6)).when(k == "KEY", _key(m, numbers))
            .when(k == "IBAN", _iban(m, numbers)).when(k == "IP", _ip(m, numbers, attempt)).when(k == "PHONE", _phone(m, numbers)).when(k == "CARD", _card(m, numbers))
            .when(k == "SSN", _shaped(m, numbers)).otherwise(_name(m, numbers, attempt, family, key))
        )

    return let(m, lambda m: let(kind(m), lambda k: let(_bytes(key, F.concat_ws(":", k, _form(m, k)), attempt), lambda numbers: drawn(m, k, numbers))))


def _mentions(text):
    return F.when(text.rlike(_QUICK), F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _apart(entities: DataFrame, key: str, rounds: int) -> DataFrame | None:
    """entity, attempt of those of the distinct ``entities(entity, m, family)`` that have to draw again; None if none has."""
    given = entities.withColumn("attempt", F.lit(0))
    moved = None
    for _ in range(rounds):
        # given names and addresses vary with the mention, so names are told apart by what stands for the entity
        drawn = given.withColumn("s", canonical(surrogate(F.col("m"), F.col("attempt"), F.col("family"), key)))
        alike = drawn.groupBy("s").agg(F.count("*").alias("n"), F.min("entity").alias("least")).where("n > 1")
        taken = drawn.join(alike.select("s", "least"), "s").where("entity <> least").select("entity")
        real = drawn.join(entities.select(F.col("entity").alias("s")), "s", "left_semi").select("entity")
        again = stored(taken.union(real).distinct(), "collisions")
        if again.isEmpty():
            return moved
        more = again.withColumn("more", F.lit(1))
        given = stored(given.join(more, "entity", "left").select("entity", "m", "family", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "draws")
        moved = given.where("attempt > 0").select("entity", "attempt")
    raise RuntimeError(f"surrogates still collide after {rounds} draws")


def collisions(mentions: DataFrame, key: str, rounds: int = 60) -> DataFrame | None:
    """entity, attempt of the entities among ``mentions(m)`` whose first surrogate another one has, or is an entity itself; None if there are none.

    Draws go on until no collision is left; forms with few surrogates widen. If ``rounds`` don't suffice it is an error.
    Surnames and all that isn't a whole name are settled first, then whole names with the surnames that came out.
    """
    # one mention stands for its entity: the least
    entities = stored(mentions.select("m", canonical(F.col("m")).alias("entity")).groupBy("entity").agg(F.min("m").alias("m")), "entities")
    whole = entities.withColumn("surname", surname(F.col("entity"))).where("surname is not null")
    short = whole.select(F.col("surname").alias("entity"), F.regexp_replace("m", f"^{_FIRST}$", "$1$2").alias("m"))
    single = entities.where(~F.col("entity").rlike(_FULL)).unionByName(short).groupBy("entity").agg(F.min("m").alias("m"))
    moved = _apart(stored(single.withColumn("family", F.lit(0)), "entities"), key, rounds)
    draws = whole.withColumn("family", F.lit(0))
    if moved is not None:
        draws = whole.join(moved.withColumnRenamed("entity", "surname"), "surname", "left").withColumn("family", F.coalesce("attempt", F.lit(0)))
    draws = _apart(stored(draws.select("entity", "m", "family"), "entities"), key, rounds)
    return draws if moved is None else moved if draws is None else moved.union(draws)


def replace(docs: DataFrame, key: str, found: str = "_found") -> DataFrame:
    """``docs`` with every mention in ``text`` replaced; all columns kept, and the column ``found`` counts the mentions (one of ``docs`` of that name is replaced).

    Null texts stay null and empty ones empty; repeated rows and null doc_ids are treated like any other; an empty
    table gives no rows. Without the key the entities can't be recovered or matched.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), docs["doc_id"].alias("_doc"), text.alias("_text"))
    rows = rows.withColumn("_m", _mentions(F.col("_text")))
    moved = collisions(rows.select(F.explode("_m").alias("m")), key)
    if moved is None:
        fresh = F.transform("_m", lambda m: surrogate(m, F.lit(0), F.lit(0), key))
    else:
        named = rows.select("_doc", F.explode(F.array_distinct("_m")).alias("m")).select("_doc", canonical(F.col("m")).alias("entity"))
        named = named.select("_doc", F.explode(F.array_compact(F.array("entity", surname(F.col("entity"))))).alias("entity"))
        redrawn = named.join(moved, "entity").distinct().groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("_again"))
        rows = rows.join(redrawn.withColumnRenamed("_doc", "_key"), rows["_doc"].eqNullSafe(F.col("_key")), "left")
        draws = lambda entity: F.coalesce(F.element_at("_again", F.coalesce(entity, F.lit(""))), F.lit(0))
        fresh = F.transform("_m", lambda m: let(canonical(m), lambda e: surrogate(m, draws(e), draws(surname(e)), key)))
    between = F.split("_text", ALL)
    out = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(fresh, lambda s, i: F.concat(s, F.get(between, i + 1))), ""))
    new = F.when(F.size("_m") == 0, F.col("_row.text")).otherwise(out)
    columns = [new.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() != found.lower()]
    return rows.select(*columns, F.size("_m").cast("long").alias(found))
