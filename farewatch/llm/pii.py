"""Personal data: detection and keyed surrogates.

Entities (e-mail, telephone, payment card, IPv4, MAC, IBAN, social security number, credentials,
persons) are replaced by surrogates drawn from HMAC-SHA256 of a key, the entity's type and its
normal form. A surrogate keeps type and format: separators, digit and letter classes, case,
country code, check digits where the original's were right, gender of given names, script of
names. Normal forms (digits only, lower case, name parts) make different spellings of one entity
get one surrogate, so coreference survives within and across documents.

Distinctness is checked over the whole corpus: all distinct entities get their first surrogate,
and those that share one with another entity, or hit an entity that really occurs, draw again
until none is left. Only these exceptions need storing; every other surrogate is recomputed from
the key while replacing. Exceptions are broadcast up to ``max_broadcast``, beyond that they are
joined to the rows that hold them.

Numbers count only with evidence: a telephone has a country code, brackets, a known national
grouping or a word such as "call" before it; a payment card has right check digits or a word such
as "card" before it; ISBNs, pairs of years and version numbers are left alone.

The key comes from the setting ``spark.farewatch.pii.key``. Without it every run draws a random
one, so its surrogates agree within the run only.

Defined results: null texts stay null with no entities, empty ones empty; texts without entities
are returned unchanged; repeated rows get the same replacements; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, read_table

KEY_SETTING = "spark.farewatch.pii.key"
MAX_BROADCAST = 100_000

# fixed values: name parts by gender and script, titles by gender
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Pierre Jean Michel Luis Carlos José Miguel".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Laura Julia Anna Petra Sabine Marie Sophie Claire María Carmen Lucía Elena".split(),
    ("m", "cyrillic"): "Александр Дмитрий Максим Сергей Андрей Алексей Иван Михаил Николай Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
}
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor господин".split(), "f": "Mrs Ms Miss Madam Frau Madame Señora госпожа".split(),
          "any": "Dr Doctor Prof Professor доктор профессор".split()}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we".split(),
             "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split()}
ENDINGS = {"latin": "ner ton man son ley field berg ski".split(), "cyrillic": "ов ин ский енко ович ук ев ын".split(),
           "cyrillic-f": "ова ина ская ева ына".split()}

_GIVEN = {n: key for key, names in GIVEN.items() for n in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"

ENTITY = re.compile("|".join([
    r"(?P<credential>(?i:\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key|auth)\b)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9+/_\-.]{8,})[\"']?)",
    r"(?P<bare>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})\b)",
    r"(?P<email>\b[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})",
    r"(?P<mac>\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b)",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d))",
    r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-]|\.\d)|(?<![\w.])\+\d{8,14}(?!\d)|(?<![\w.+-])\d{7,12}(?![\w-]|\.\d))",
    rf"(?P<person>\b(?P<title>{'|'.join(_TITLE)})\.?\s+(?P<names>{_NAME}(?:\s{_NAME})?)|\b(?P<given>{'|'.join(_GIVEN)})\s(?P<family>{_NAME})\b)",
]))
# texts that can hold an entity at all. Arrow's RE2 knows \b, \d and \s for ASCII only, so none of
# them is used: every match of ENTITY holds one of these, whatever its script
MAYBE = (r"[\p{Nd}@=:]|(?:" + "|".join([*_TITLE, *_GIVEN]) + r")[^\p{L}\p{N}_]"
         r"|AKIA|gh[pousr]_|sk-|xox[abpr]-|[A-Fa-f]{2}-[A-Fa-f]{2}-[A-Fa-f]{2}-")


# fixed values: words that announce a kind of number, national groupings of telephones
CALLED = re.compile(r"(?i)\b(?:call|dial|ring|tel|telephone|phone|fax|mobile|cell|sms|whatsapp|telefon|téléphone|teléfono|телефон|тел|звоните)\b\W{0,3}(?:[^\W\d]+\W{1,3}){0,2}$")
CARDED = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|karte|carte|tarjeta|карта)\b")
VERSION = re.compile(r"(?i)(?:\b(?:version|ver|release|build|firmware)\b|\bv)[.:]?\s*$")
NATIONAL = re.compile(r"[2-9]\d\d([ .-])[2-9]\d\d\1\d{4}|0\d([ .-])\d\d(?:\2\d\d){3}|0\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}")
DATE = re.compile(r"(?:19|20)\d\d([ .-])\d\d\1\d\d|(?:1[5-9]|20)\d\d[ .-](?:1[5-9]|20)\d\d")      # a day, or two years


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _isbn(digits: str) -> bool:
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(digits)) % 10 == 0


def _is_card(text: str, start: int, norm: str) -> bool:
    return not _isbn(norm) and (luhn(norm) or bool(CARDED.search(text, max(0, start - 64), start)))


def _is_phone(text: str, m: re.Match, norm: str) -> bool:
    if not 7 <= len(norm) <= 15 or DATE.fullmatch(m[0]):
        return False
    return m[0][0] == "+" or "(" in m[0] or bool(NATIONAL.fullmatch(m[0]) or CALLED.search(text[max(0, m.start() - 32):m.start()]))


def _gender(title: str, given: str) -> str:
    """Of a title, or if it says nothing of the given name: by the lists, then by its ending."""
    if _TITLE[title] != "any":
        return _TITLE[title]
    return _GIVEN[given][0] if given in _GIVEN else "f" if given[-1] in "aая" else "m"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text; persons come as name parts."""
    out = []
    for m in ENTITY.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("secret", "names", "title", "family", "given") else None
        for k in ("credential", "bare", "email", "mac", "ip", "iban", "ssn", "card", "phone", "person"):
            if m[k] is not None:
                kind = k
                break
        if kind == "credential":
            out.append((m.start("secret"), m.end("secret"), "secret", m["secret"]))
        elif kind == "bare":
            out.append((m.start(), m.end(), "secret", m[0]))
        elif kind == "email":
            out.append((m.start(), m.end(), "email", m[0].lower()))
        elif kind == "mac":
            out.append((m.start(), m.end(), "mac", re.sub("[:-]", "", m[0]).lower()))
        elif kind == "ip" and not VERSION.search(text[max(0, m.start() - 16):m.start()]):
            out.append((m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m[0].split("."))))
        elif kind == "iban":
            norm = m[0].replace(" ", "")
            if len(norm) >= 15 and _iban_ok(norm):
                out.append((m.start(), m.end(), "iban", norm))
        elif kind == "ssn":
            out.append((m.start(), m.end(), "ssn", _digits(m[0])))
        elif kind == "card":
            norm = _digits(m[0])
            if _is_card(text, m.start(), norm):
                out.append((m.start(), m.end(), "card", norm))
        elif kind == "phone":
            norm = _digits(m[0])
            if _is_phone(text, m, norm):
                out.append((m.start(), m.end(), "phone", norm))
        elif kind == "person":
            if m["title"]:
                parts = m["names"].split()
                at, gender = m.start("names"), _gender(m["title"], parts[0])
            else:
                at, gender = m.start(), _GIVEN[m["given"]][0]
                parts = m[0].split()
            for k, part in enumerate(parts):
                a = text.index(part, at)
                at = a + len(part)
                script = "cyrillic" if re.match("[А-Яа-яЁё]", part) else "latin"
                given = k == 0 and len(parts) > 1 or part in _GIVEN
                if not given and script == "cyrillic" and part.lower().endswith(("ова", "ева", "ина", "ая")):
                    script = "cyrillic-f"
                out.append((a, at, f"given-{gender}-{script}" if given else f"family-{script}", part.lower()))
    return out


class _Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.n, self.pool = (key, f"{kind}\0{norm}\0{attempt}".encode("utf-8", "surrogatepass")), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.seed[0], self.seed[1] + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v % n


def _classes(s: str, draw) -> str:
    """Each digit, lower-case and upper-case ASCII letter by another of its class."""
    return "".join(chr(48 + draw(10)) if c.isdigit() else chr(97 + draw(26)) if "a" <= c <= "z" else chr(65 + draw(26)) if "A" <= c <= "Z" else c
                   for c in s)


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The normal form that replaces (kind, norm), another one for every attempt; never itself."""
    for again in range(100):
        new = _draw(key, kind, norm, attempt, _Stream(key, kind, norm, 1000 * again + attempt).below)
        if new != norm:
            return new
    raise ValueError(f"no surrogate for a {kind}")


def _draw(key: bytes, kind: str, norm: str, attempt: int, draw) -> str:
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        keep = 2 if len(labels) > 2 else 1
        # one domain stays one domain, unless the whole address collides
        own = [_classes(x, draw if attempt else _Stream(key, "domain", x, 0).below) for x in labels[:-keep]]
        return _classes(local, draw) + "@" + ".".join(own + labels[-keep:])
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", norm):
            abc = "0123456789abcdef" if norm == norm.lower() else "0123456789ABCDEF"
            return "".join(abc[draw(16)] for _ in norm)
        head = next((p for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-") if norm.startswith(p)), "")
        return head + _classes(norm[len(head):], draw)
    if kind == "mac":
        return "".join("0123456789abcdef"[draw(16)] for _ in norm)
    if kind == "ip":
        return ".".join(str(1 + draw(223) if k == 0 else draw(255)) for k in range(4))
    if kind == "iban":
        body = _classes(norm[4:], draw)
        rest = int("".join(str(int(c, 36)) for c in body + norm[:2]) + "00") % 97
        return f"{norm[:2]}{98 - rest:02d}{body}"
    if kind == "card":
        body = norm[0] + "".join(str(draw(10)) for _ in norm[1:-1])
        last = str(draw(10))
        if luhn(norm):
            last = next(d for d in "0123456789" if luhn(body + d))
        elif luhn(body + last):
            last = str((int(last) + 1) % 10)
        return body + last
    if kind == "phone":
        keep = max(len(norm) - 10, 0)              # country code
        return norm[:keep] + "".join(str(1 + draw(9) if k == 0 else draw(10)) for k in range(len(norm) - keep))
    if kind == "ssn":
        return f"9{draw(100):02d}{draw(99) + 1:02d}{draw(9999) + 1:04d}"       # 9xx: never issued
    if kind.startswith("given-"):
        _, gender, script = kind.split("-")
        names = [n.lower() for n in GIVEN[gender, script]]
        if attempt < 3:
            return names[draw(len(names))]
        if attempt < 6:
            return names[draw(len(names))] + "-" + names[draw(len(names))]
        # the first name keeps the gender; the second part grows, so there is room for any number
        parts = SYLLABLES[script]
        return names[draw(len(names))] + "-" + "".join(parts[draw(len(parts))] for _ in range(attempt // 3))
    script = kind.partition("-")[2]
    parts = SYLLABLES[script.partition("-")[0]]
    return "".join(parts[draw(len(parts))] for _ in range(2 + draw(2) + attempt // 4)) + ENDINGS[script][draw(len(ENDINGS[script]))]


def spell(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("card", "ssn", "phone", "mac", "iban"):
        it = iter(new)
        out = "".join(next(it, "") if c.isalnum() else c for c in mention)
        return out.upper() if mention.upper() == mention else out
    if kind == "email" and mention.upper() == mention:
        return new.upper()
    if kind.startswith(("given", "family")):
        return "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    return new


ENT = pa.schema([("kind", pa.string()), ("norm", pa.string())])


def _candidates(texts: pa.Array):
    return pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_numpy(zero_copy_only=False)


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (kind, norm) of all texts; made distinct inside each task first."""
    def run(batches):
        for b in batches:
            held = {(k, n) for t, ok in zip(b.column(1), _candidates(b.column(1)), strict=True) if ok for _, _, k, n in find(t.as_py())}
            if held:
                k, n = zip(*sorted(held), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], schema=ENT)
    return id_text(docs).mapInArrow(run, "kind string, norm string").distinct()


def resolve(known: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate collides.

    There may be more given names than names in the lists, so their later attempts join two, then a
    name and ever more syllables. A surrogate may not equal a real entity, nor another's surrogate."""
    make = F.udf(lambda k, n, a: surrogate(key, k, n, a), "string")
    now = materialise(known.withColumn("attempt", F.lit(0)).withColumn("sur", make("kind", "norm", "attempt")), "pii-surrogates")
    for _ in range(rounds):
        owner = now.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "norm")).alias("o"), F.count(F.lit(1)).alias("c"))
        real = now.select(F.col("kind").alias("rk"), F.col("norm").alias("rn"))
        hit = (now.join(real, (F.col("kind") == F.col("rk")) & (F.col("sur") == F.col("rn"))).select("kind", "norm"))
        shared = (now.join(owner.where("c > 1").select(F.col("kind").alias("ok"), F.col("sur").alias("os"), F.col("o.norm").alias("on")),
                           (F.col("kind") == F.col("ok")) & (F.col("sur") == F.col("os"))).where("norm <> on").select("kind", "norm"))
        bad = materialise(hit.unionByName(shared).distinct().select(F.col("kind").alias("bk"), F.col("norm").alias("bn")), "pii-collisions")
        if not bad.limit(1).count():
            return now.where("attempt > 0").select("kind", "norm", "attempt")
        joined = now.join(bad, (F.col("kind") == F.col("bk")) & (F.col("norm") == F.col("bn")), "left")
        step = joined.withColumn("attempt", F.when(F.col("bk").isNull(), F.col("attempt")).otherwise(F.col("attempt") + 1))
        now = materialise(step.select("kind", "norm", "attempt", F.when(F.col("bk").isNull(), F.col("sur"))
                                      .otherwise(make("kind", "norm", "attempt")).alias("sur")), "pii-surrogates")
    raise ValueError(f"surrogates still collide after {rounds} rounds")


OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("kinds", pa.list_(pa.string()))])
DDL = "doc_id long, text string, n_entities long, kinds array<string>"


def rewrite(text: str, key: bytes, again: dict) -> tuple[str, list[str]]:
    parts, at, kinds = [], 0, []
    for a, e, kind, norm in find(text):
        parts += [text[at:a], spell(kind, text[a:e], surrogate(key, kind, norm, again.get((kind, norm), 0)))]
        at = e
        kinds.append(kind)
    return "".join([*parts, text[at:]]), kinds


def replace(docs: DataFrame, key: bytes | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row, with surrogates for its entities; without a
    key the setting's, or else a random one."""
    base = id_text(docs)
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY_SETTING, "").encode() or secrets.token_bytes(32)
    again = materialise(resolve(entities(base), key), "pii-exceptions")
    if again.count() <= max_broadcast:                    # the size check of the broadcast
        shared = spark.sparkContext.broadcast({(r["kind"], r["norm"]): r["attempt"] for r in again.collect()})
        rows = base.withColumn("again", F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        shared = spark.sparkContext.broadcast({})
        keyed = materialise(base.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
        listed = F.udf(lambda t: sorted({(k, n) for _, _, k, n in find(t)}) if t else [], "array<struct<kind:string,norm:string>>")
        held = keyed.select("row", F.explode(listed("text")).alias("e")).select("row", "e.kind", "e.norm")
        own = held.join(again, ["kind", "norm"]).groupBy("row").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("again"))
        rows = keyed.join(own, "row", "left").select("doc_id", "text", "again")

    def run(batches):
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, ok, own in zip(b.column(1), _candidates(b.column(1)), b.column(2), strict=True):
                new, found = t.as_py(), []
                if ok:
                    more = {(x["kind"], x["norm"]): x["attempt"] for x in own.as_py() or []}
                    new, found = rewrite(new, key, more or shared.value)
                texts.append(new)
                counts.append(len(found))
                kinds.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(kinds, pa.list_(pa.string()))], schema=OUT)
    return rows.mapInArrow(run, DDL)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(read_table(spark, sf_dir, "documents"))
