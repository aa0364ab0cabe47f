"""Personal data and secrets replaced by surrogates (DataFrame expressions only).

Detected: e-mail addresses, IPv4 addresses (not after ``version``), phone numbers, 123-45-6789 numbers, card numbers (16
digits; 13 to 19 with a valid Luhn sum), IBANs, secrets (after a word such as ``token =``, by a known key prefix, or hex
strings of 32 or more), and person names in Latin and Cyrillic script (after a title, or a known given name before a
capitalised name; with particles, hyphens, as McDonald or O'Brien, in capitals).

Bare mentions: every given name and surname of a person found in a text is also replaced where it stands alone in that
text, as written or in capitals, unless it is a month or weekday, or the text also uses it as a lower-case word (in "Mr.
Baker is a baker", a bare ``Baker`` stays).

Surrogates: a keyed digest of (kind, value) picks a replacement of the same kind and format: digits for digits, letters
for letters of the same case, hex for hex; a phone keeps its country code, a card its Luhn validity, an IBAN its country
and valid check digits; an e-mail domain maps by itself, below ``.example``; given names keep gender and script, names
their capitalisation; Cyrillic surnames keep their feminine ending (Иванов and Иванова stay one family). Names are
replaced word by word, so ``Mr. Smith`` and ``John Smith`` stay one family.

Distinctness and coreference: the digest makes equal values equal everywhere. Names and e-mail addresses are equal
without case, cards, phones and IBANs without their punctuation; the found format is written again. All distinct values
of the corpus are checked: two values with one surrogate, or a surrogate that is itself a value of the corpus, are given
a further attempt until every value has its own; values that needed one are kept in a table of exceptions, joined when
texts are rewritten.

The key is the argument ``key``, else the session's ``spark.soilcast.surrogateKey``, else a published one, which hides
nothing from who knows it: set the setting wherever surrogates must not be guessed back.

Scale: every text is searched once; the result is written to the shared folder as a table of the rows in which a text
with findings is replaced by its kept pieces and its findings, and all further steps read that. Only findings and the
rows that have them are shuffled, by the text's MD5, and equal texts count once; the collision check works on distinct
values made by map-side combined grouping, so a value in a third of all rows is one row per task. Rows without findings
never move. The joins are plain: their sides' sizes decide.

Nulls and edges: a null or empty text stays as it is, with 0 findings; repeated rows are each rewritten alike; all other
columns pass unchanged, whatever their names; an empty table gives an empty result. Texts are searched whole; a text may
contain any character, the marks used inside included.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from soilcast.llm.common import cut_lineage, fresh, let, written

KEY = "surrogate-key-1"
KEY_SETTING = "spark.soilcast.surrogateKey"
ROUNDS = 40
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

TITLES = {"m": ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин", "г-н"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Sra", "Señora", "Госпожа", "г-жа"],
          "x": ["Dr", "Prof"]}
# Common given names that are not ordinary words, months or places.
GIVEN = {
    "m_latin": "James John Robert Michael William David Richard Thomas Daniel Paul Peter Matthew Anthony Steven Andrew "
               "Kevin Brian George Edward Ahmed Mohammed Raj Arjun Hans Klaus Jürgen Wolfgang Stefan Pierre Jean "
               "Michel François Luis Carlos José Juan Miguel Antonio Giovanni Marco".split(),
    "f_latin": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily Emma Olivia Hannah Amanda "
               "Michelle Rebecca Fatima Aisha Priya Anjali Anna Petra Sabine Ursula Monika Marie Sophie Isabelle "
               "Camille Carmen Lucía Pilar Elena Laura Giulia Francesca".split(),
    "m_cyrillic": "Иван Алексей Дмитрий Сергей Николай Андрей Михаил Павел Владимир Александр".split(),
    "f_cyrillic": "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
}
# Capitalised words that follow a title or given name without being a name.
NOT_NAMES = ("The A An And Of In On At For To With From By Or But Not Is Was Are As It Christmas Universe World Jacket "
             "Street Avenue Road University College Hospital School Church").split()
# Names of months and weekdays, which are never bare mentions of a person.
CALENDAR = ("January February March April May June July August September October November December Monday Tuesday "
            "Wednesday Thursday Friday Saturday Sunday").split()
SYLLABLES = {"latin": "ba ber cal den dor fer gan hal kor lan mar nor pel ran sol tan vel wes".split(),
             "cyrillic": "ба бер вал дор гор кал лан мар нов пел рад сол тан вер зор кин".split()}
ENDINGS = {"m_latin": "o en us".split(), "f_latin": "a ia ine".split(), "x_latin": "er on is".split(),
           "m_cyrillic": "ий ан ор".split(), "f_cyrillic": "а ия ина".split(), "x_cyrillic": "ов ин ко".split()}

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_PARTICLES = "van von der den de del della la le du da dos di bin ibn al el ten ter zu".split()
# McDonald, O'Brien, DeLuca; a name in capitals stands among names in capitals
_WORD_OF_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_NAME = rf"{_WORD_OF_NAME}(?:-{_WORD_OF_NAME})?"
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + rf")(?:-{_WORD_OF_NAME})?"
_CAPS = r"(?:\p{Lu}['’])?\p{Lu}{2,}(?:-\p{Lu}{2,})?"
_PARTICLE = "(?:(?:" + "|".join(_PARTICLES) + ") ){0,3}"
_NO = "(?!(?:" + "|".join(NOT_NAMES) + r")(?!\p{L}))"
_GIVEN_CAPS = "(?:" + "|".join(n.upper() for ns in GIVEN.values() for n in ns) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LEAD = r"(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?)"
# shorter ones need a digit, as ordinary words have none
_SECRET = r"(?:[A-Za-z0-9_+/=-]{8,}|(?=[A-Za-z_+/=-]*\d)[A-Za-z0-9_+/=-]{6,7})"
_PREFIXED = (r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abps]-[A-Za-z0-9-]{10,}"
             r"|(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9]))")
_EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
_IP = rf"(?<![vV]ersion )(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_PHONE = (r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}"
          r"|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{5,8})(?!\d)")
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?!\d)"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PERSON = (rf"(?:{_TITLE} (?:{_PARTICLE}{_NO}{_NAME}(?: {_PARTICLE}{_NO}{_NAME}){{0,2}}(?!\p{{L}})"
           rf"|{_CAPS}(?: {_CAPS}){{0,2}})|{_GIVEN} {_PARTICLE}{_NO}{_NAME}|{_GIVEN} {_CAPS}|{_GIVEN_CAPS} {_CAPS})"
           r"(?!\p{L})")
# a look at the first character spares most words most of the alternatives
FIND = (rf"(?<![\p{{L}}\p{{N}}])(?:(?=[TtSsPpAa]){_LEAD}{_SECRET}|(?=[AgsxB-Fb-f0-9]){_PREFIXED}|{_EMAIL}"
        rf"|(?=[A-Z]){_IBAN}|(?=[0-9+(])(?:{_IP}|{_PHONE}|{_SSN}|{_CARD})|(?=[\p{{Lu}}г]){_PERSON})")
# a capitalised word by itself, which may be the bare mention of a name
_BARE = rf"(?<![\p{{L}}\p{{N}}])(?:{_NAME}|{_CAPS})(?![\p{{L}}\p{{N}}])"
# the ending that a woman's surname adds
_FEMININE = "(?<=(?:ов|ев|ёв|ин|ын))а$"
_MARK, _ESC = "\x01", "\x03"
# Country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,2}$)"
# Lower-case letters by script, for letters beyond ASCII; scripts without cases have one row.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
             "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
             "Han": "山水火木金土日月人口田石天地大小中上下東西南北"}


def session_key(spark: SparkSession) -> str:
    """The key of surrogates: the session's setting, else the published one."""
    return spark.conf.get(KEY_SETTING, KEY)


def _escaped(text: Column) -> Column:
    """``text`` without ``_MARK``, so that marks can be set; no pattern here matches a control character."""
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "\x04")), F.lit(_MARK), F.lit(_ESC + "\x05"))


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC + "\x05"), F.lit(_MARK)), F.lit(_ESC + "\x04"), F.lit(_ESC))


def _cut(text: Column, pattern: str) -> Column:
    """``text`` cut at the matches of ``pattern``, in one search: kept and matched pieces by turns."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def _kept(value: Column) -> Column:
    return F.struct(F.lit("").alias("lead"), F.lit("").alias("kind"), value.alias("value"))


def _is_name(kind: Column) -> Column:
    return F.rlike(kind, F.lit("^(given|surname)_"))


def _with_bare_mentions(tokens: Column) -> Column:
    """``tokens`` with the bare mentions of the names among them cut out of what is kept."""
    def mentions(names: Column) -> Column:
        def cut(t: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                same = F.filter(names, lambda n: (n["value"] == w) | (F.upper(n["value"]) == w) | (
                    (F.upper(n["value"]) == n["value"]) & (F.initcap(n["value"]) == w)))
                return let(same, lambda c: F.when((i % 2 == 1) & (F.size(c) > 0), F.struct(
                    F.lit("").alias("lead"), F.get(c, F.lit(0))["kind"].alias("kind"), w.alias("value"))).otherwise(
                    _kept(w)))

            return F.when(t["kind"] != "", F.array(t)).otherwise(F.transform(_cut(F.concat(t["lead"], t["value"]), _BARE), one))

        return F.when(F.size(names) == 0, tokens).otherwise(F.flatten(F.transform(tokens, cut)))

    def usable(plain: Column) -> Column:
        # surnames first: a word that is both in a text is a surname where it stands alone
        names = F.array_sort(F.array_distinct(F.transform(
            F.filter(tokens, lambda t: _is_name(t["kind"])), lambda t: F.struct(t["kind"], t["value"]))),
            lambda a, b: F.when(a["kind"] > b["kind"], -1).when(a["kind"] < b["kind"], 1).when(
                a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
        return F.filter(names, lambda n: (F.length(n["value"]) >= 2) & ~_one_of(F.initcap(n["value"]), CALENDAR)
                        & ~F.array_contains(plain, F.lower(n["value"])))

    words = F.flatten(F.transform(F.filter(tokens, lambda t: t["kind"] == ""),
                                  lambda t: F.split(t["value"], r"[^\p{L}'’-]+")))
    return F.when(~F.exists(tokens, lambda t: _is_name(t["kind"])), tokens).otherwise(
        let(words, lambda plain: let(usable(plain), mentions)))


def taken_apart(text: Column) -> Column:
    """A text as (n, kept, found): ``n`` findings, whose values to replace are ``found``, an array of (kind, value), and the
    text around them, ``kept``, one more than ``found``. Null for a text without findings. One search of the text."""
    def parts(pieces: Column) -> Column:
        per = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, tokens_of(p)).otherwise(F.array(_kept(p))))
        return F.when(F.size(pieces) > 1, let(per, whole))

    def whole(per: Column) -> Column:
        n = F.size(F.filter(per, lambda ts: F.exists(ts, lambda t: t["kind"] != "")))
        return let(F.flatten(per), lambda ts: let(_with_bare_mentions(ts), lambda full: let(
            F.filter(full, lambda t: t["kind"] != ""), lambda found: F.when(F.size(found) > 0, F.struct(
                (n + F.size(found) - F.size(F.filter(ts, lambda t: t["kind"] != ""))).cast("long").alias("n"),
                F.split(F.array_join(F.transform(full, lambda t: F.concat(t["lead"], F.when(
                    t["kind"] == "", t["value"]).otherwise(F.lit(_MARK)))), ""), _MARK, -1).alias("kept"),
                F.transform(found, lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value")))
                .alias("found"))))))

    return let(_cut(_escaped(text), FIND), parts)


def _one_of(col: Column, values: list[str]) -> Column:
    return col.isin(*values)


def tokens_of(found: Column) -> Column:
    """A finding as an array of (lead, kind, value): the value is replaced, the lead is kept; kind '' keeps both."""
    def token(kind, value, lead=F.lit("")):
        return F.struct(lead.alias("lead"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                        value.alias("value"))

    def whole(pattern: str) -> Column:
        return F.rlike(found, F.lit(f"^(?:{pattern})$"))

    lead = F.regexp_extract(found, "^" + _LEAD, 0)
    script = lambda w: F.when(F.rlike(w, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")

    def name_tokens(parts: Column) -> Column:
        title = F.regexp_replace(parts[0], r"\.$", "")
        by_title = F.when(_one_of(title, TITLES["m"]), "m").when(_one_of(title, TITLES["f"]), "f").otherwise("x")
        has_title = F.rlike(parts[0], F.lit(f"^{_TITLE}$"))

        def one(w: Column, i: Column) -> Column:
            stem = F.initcap(F.substring_index(w, "-", 1))
            known = F.when(_one_of(stem, GIVEN["m_latin"] + GIVEN["m_cyrillic"]), "m").when(
                _one_of(stem, GIVEN["f_latin"] + GIVEN["f_cyrillic"]), "f")
            first = F.when(has_title, F.lit(1)).otherwise(F.lit(0))
            particle = _one_of(w, _PARTICLES)
            given = (i == first) & (i < F.size(parts) - 1)
            kind = F.when((has_title & (i == 0)) | particle, "").when(
                given, F.concat(F.lit("given_"), F.coalesce(known, by_title), F.lit("_"), script(w))).otherwise(
                F.concat(F.lit("surname_x_"), script(w)))
            return token(kind, w, F.when(i > 0, " ").otherwise(""))

        return F.transform(parts, one)

    return (F.when(lead != "", F.array(token("secret", F.substr(found, F.length(lead) + 1), lead)))
            .when(whole(_PREFIXED), F.array(token("secret", found)))
            .when(whole(_EMAIL), F.array(token("email", found)))
            .when(whole(_IBAN), F.array(token(F.when(
                (_mod97(F.replace(found, F.lit(" "))) == 1) | (F.length(_digits(found)) > 13), "iban").otherwise(""), found)))
            .when(whole(_IP), F.array(token("ip", found)))
            .when(whole(_SSN), F.array(token("ssn", found)))
            .when(whole(_CARD), F.array(token(F.when((F.length(_digits(found)) == 16) | (_luhn(found) == 0), "card")
                                              .otherwise(""), found)))
            .when(whole(_PHONE), F.array(token("phone", found)))
            .otherwise(let(F.split(found, " "), name_tokens)))


def _pick(seed: Column, i, chars: str) -> Column:
    return F.substr(F.lit(chars), (F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)),
                                          F.lit(len(chars))) + 1).cast("int"), F.lit(1))


def _masked(value: Column, seed: Column, keep: Column | None = None, hexes: bool = True) -> Column:
    """The value with every digit and letter replaced by one of its class and script; the first ``keep`` characters
    stay. ``hexes``: hex strings stay hex."""
    hexed = F.rlike(value, F.lit("^(?=.*[a-f])[0-9a-f]{8,}$")) & F.lit(hexes)
    upper_hexed = F.rlike(value, F.lit("^(?=.*[A-F])(?=.*[0-9])[0-9A-F]{8,}$")) & F.lit(hexes)

    def one(c: Column, i: Column) -> Column:
        new = F.when(hexed, _pick(seed, i, HEX)).when(upper_hexed, F.upper(_pick(seed, i, HEX))).when(
            F.rlike(c, F.lit("^[0-9]$")), _pick(seed, i, DIGITS)).when(
            F.rlike(c, F.lit("^[a-z]$")), _pick(seed, i, LOWER)).when(F.rlike(c, F.lit("^[A-Z]$")), _pick(seed, i, UPPER))
        for script, letters in ALPHABETS.items():
            new = new.when(F.rlike(c, F.lit(rf"^[\p{{L}}&&\p{{Is{script}}}]$")), F.when(
                F.rlike(c, F.lit(r"^\p{Lu}$")), _pick(seed, i, letters.upper())).otherwise(_pick(seed, i, letters)))
        new = (new.when(F.rlike(c, F.lit(r"^\p{Lu}$")), _pick(seed, i, UPPER))
               .when(F.rlike(c, F.lit(r"^\p{L}$")), _pick(seed, i, LOWER)).otherwise(c))
        return F.when(i < keep, c).otherwise(new) if keep is not None else new

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _in_format(value: Column, chars: Column, of: str = "0-9") -> Column:
    """The k-th character of class ``of`` in ``value`` replaced by the k-th of ``chars``; all else stays."""
    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), f"[^{of}]", ""))
        return F.when(F.rlike(c, F.lit(f"^[{of}]$")), F.substr(chars, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _mod97(iban: Column) -> Column:
    """The IBAN (without spaces) modulo 97: 1 if its check digits are right."""
    moved = F.filter(F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(
        F.rlike(c, F.lit("^[0-9]$")), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of the digits in ``number``."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    digits = F.filter(digits, lambda c: c != "")
    return F.aggregate(F.transform(digits, lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(
        v > 9, v - 9).otherwise(v))), F.lit(0), lambda a, v: a + v) % 10


def _element(seed: Column, i, values: list[str]) -> Column:
    at = F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(len(values))) + 1
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int"))


def _made_name(seed: Column, attempt: Column, syllables: list[str], endings: list[str]) -> Column:
    """Two syllables and an ending; further attempts grow longer, so there are always enough names."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(1) + F.floor(attempt / 4).cast("int")),
                        lambda i: _element(seed, i, syllables))
    return F.concat(F.array_join(parts, ""), _element(seed, 99, endings))


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a value of a kind at an attempt."""
    name = _is_name(kind)
    same = identity(kind, value)
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, F.when(name, F.lower(same)).otherwise(same),
                              attempt.cast("string")), 256)

    def build(s: Column) -> Column:
        more = F.when(attempt < 3, "").otherwise(F.array_join(F.transform(
            F.sequence(F.lit(0), F.least(attempt, F.lit(12))), lambda i: _pick(s, i + 1000, LOWER)), ""))
        domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lower(F.substring_index(value, "@", -1))), 256)
        email = F.concat(_masked(F.substring_index(value, "@", 1), s, hexes=False), more, F.lit("@"),
                         F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _pick(domain, i, LOWER)),
                                      ""), F.lit(".example"))
        octet = lambda i, low, n: (F.pmod(F.xxhash64(s, F.lit(i)), F.lit(n)) + low).cast("string")
        ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
        # a phone and a card are made from their digits and written in the format that was found
        phone = _in_format(value, _digits(_masked(same, s, F.length(F.regexp_extract(same, _COUNTRY, 0)))))
        ssn = F.concat(F.lit("9"), F.substr(_masked(value, s), F.lit(2)))

        def card_of(m: Column) -> Column:
            # with a 0 at the end, the Luhn sum tells which last digit makes the number valid
            base = F.concat(F.substr(m, F.lit(1), F.length(m) - 1), F.lit("0"))
            fit = ((F.lit(10) - _luhn(base)) % 10).cast("string")
            return F.when(_luhn(value) == 0, F.concat(F.substr(m, F.lit(1), F.length(m) - 1), fit)).otherwise(m)

        card = _in_format(value, let(_masked(same, s), card_of))

        def iban_of(m: Column) -> Column:
            country = F.substr(same, F.lit(1), F.lit(2))
            check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), m))).cast("string"), 2, "0")
            return F.concat(country, check, m)

        iban = _in_format(value, let(_masked(F.substr(same, F.lit(5)), s, hexes=False), iban_of), "A-Z0-9")

        def named() -> Column:
            out = None
            for sc, syllables in SYLLABLES.items():
                for g in "mfx":
                    new = _made_name(s, attempt, syllables, ENDINGS[f"{g}_{sc}"])
                    known = GIVEN.get(f"{g}_{sc}")
                    if known:
                        pick = _element(s, 7, known)
                        is_given = F.rlike(kind, F.lit("^given_"))
                        new = F.when(is_given & (attempt == 0), pick).otherwise(new)
                    here = F.rlike(kind, F.lit(f"_{g}_{sc}$"))
                    out = F.when(here, new) if out is None else out.when(here, new)
            out = F.when(F.rlike(kind, F.lit("^surname_.*cyrillic$")) & F.rlike(F.lower(value), F.lit(_FEMININE))
                         & F.rlike(out, F.lit("(?:ов|ин)$")), F.concat(out, F.lit("а"))).otherwise(out)
            return F.when(F.upper(value) == value, F.upper(out)).otherwise(F.initcap(out))

        return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone)
                .when(kind == "iban", iban).when(kind == "ssn", ssn).when(kind == "card", card).when(name, named())
                .when(kind == "secret", _masked(value, s)).otherwise(value))

    return F.when(kind == "", value).otherwise(let(seed, build))


def identity(kind: Column, value: Column) -> Column:
    """What makes two values the same: names and e-mail addresses compare without case (Cyrillic surnames without their
    feminine ending), cards by their digits, IBANs without spaces, phones by their digits and a leading plus."""
    name = F.initcap(F.translate(value, "’", "'"))
    return (F.when(F.rlike(kind, F.lit("^surname_.*cyrillic$")), F.regexp_replace(name, _FEMININE, ""))
            .when(_is_name(kind), name)
            .when(kind == "email", F.lower(value)).when(kind == "card", _digits(value))
            .when(kind == "iban", F.replace(value, F.lit(" ")))
            .when(kind == "phone", F.regexp_replace(value, "[^0-9+]", "")).otherwise(value))


def exceptions(values: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, attempt) of the values of (kind, value) whose first surrogate was taken or is itself a value."""
    known = cut_lineage(values.where("kind <> ''").select("kind", identity(F.col("kind"), F.col("value"))
                                                          .alias("value")).dropDuplicates())
    taken = cut_lineage(known.withColumn("attempt", F.lit(0)).withColumn(
        "s", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
    for _ in range(ROUNDS):
        # a surrogate that several values share goes to the smallest (attempt, value); none may be a value itself
        owner = taken.groupBy("kind", "s").agg(F.min(F.struct("attempt", "value")).alias("o"), F.count("*").alias("n"))
        real = known.select("kind", F.col("value").alias("s"), F.lit(True).alias("real"))
        bad = owner.join(real, ["kind", "s"], "left").where("n > 1 or real").select(
            "kind", "s", F.when(F.col("real"), F.lit(None)).otherwise(F.col("o.value")).alias("stays"),
            F.lit(True).alias("bad"))
        if not bad.limit(1).count():
            break
        marked = taken.join(bad, ["kind", "s"], "left")
        again = F.coalesce(F.col("bad"), F.lit(False)) & ~F.coalesce(F.col("stays") == F.col("value"), F.lit(False))
        # the new attempt is a column of its own step: inside lambdas its name must mean one thing
        tried = marked.select("kind", "value", (F.col("attempt") + again.cast("int")).alias("attempt"),
                              again.alias("again"), "s")
        taken = cut_lineage(tried.select("kind", "value", "attempt", F.when(
            F.col("again"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("s"))
            .alias("s")))
    else:
        raise RuntimeError("surrogates did not become distinct")
    return taken.where("attempt > 0").select("kind", "value", "attempt")


def replace(docs: DataFrame, text_col: str = "text", key: str | None = None, found_into: str | None = None,
            n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the findings in ``text_col`` replaced; ``found_into``: a column for their number;
    ``n_chars_col``, if there, is counted again for rewritten rows; ``key``: else of the session's setting."""
    key = session_key(docs.sparkSession) if key is None else key
    k, cut, subs = fresh(docs, "key_", "cut_", "surrogates_")
    text = F.col(f"`{text_col}`")
    count = found_into or fresh(docs, "found_")[0]
    # every text is searched here and nowhere else; where it has findings, its pieces stand in its place
    searched = docs.select("*", taken_apart(text).alias(cut))
    hit = F.col(cut).isNotNull()
    searched = written(searched.withColumn(k, F.when(hit, F.md5(F.encode(text, "UTF-8")))).withColumn(
        text_col, F.when(~hit, text)), "pii-searched")
    clean = searched.where(~hit).withColumn(count, F.lit(0).cast("long"))
    hits = searched.where(hit)
    # per distinct text: its findings; their index puts them back in order
    found = hits.select(F.col(k).alias("k"), F.posexplode(f"`{cut}`.found").alias("i", "t"))
    found = cut_lineage(found.select("k", "i", "t.kind", "t.value").dropDuplicates(["k", "i"]))
    odd = exceptions(found.select("kind", "value"), key).select(
        F.col("kind").alias("e_kind"), F.col("value").alias("e_value"), "attempt")
    done = found.join(odd, (F.col("kind") == F.col("e_kind"))
                      & (identity(F.col("kind"), F.col("value")) == F.col("e_value")), "left")
    new = surrogate(F.col("kind"), F.col("value"), F.coalesce("attempt", F.lit(0)), key)
    per_text = done.select("k", "i", new.alias("s")).groupBy(F.col("k").alias(k)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias(subs))
    whole = _unescaped(F.array_join(F.zip_with(F.col(f"`{cut}`.kept"), F.col(subs),
                                               lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))
    redone = hits.join(per_text, k).withColumn(count, F.col(f"`{cut}`.n")).withColumn(text_col, whole)
    if n_chars_col in docs.columns:
        redone = redone.withColumn(n_chars_col, F.char_length(F.col(f"`{text_col}`")).cast(
            docs.schema[n_chars_col].dataType))
    names = [F.col(f"`{c}`") for c in docs.columns] + ([F.col(count)] if found_into else [])
    return clean.select(*names).union(redone.select(*names))
