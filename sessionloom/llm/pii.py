"""Personal data replaced by surrogates.

Detected entities get keyed replacements of the same kind, script and format: every digit becomes a digit and every
letter a letter of the same case and alphabet, separators and fixed parts stay. The mapping is a keyed permutation of all
texts of one format (a Feistel network over the variable characters), so different entities never collide and the same entity
is replaced alike wherever it stands. Given names after a title are exchanged for names of the same gender and script, the other
words of the name for words of the same sounds; where a text names the person again without the title, the same words stand
there. Card and account numbers with right check digits get numbers with right ones. Secrets are taken as a whole run of any length.
:func:`checked` holds the results against each other: no surrogate may stand for two entities.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stage

# A word of a name: letters with apostrophes inside, or an initial with its dot; and what may stand between or before such words and stays.
_WORD = r"[A-ZÀ-ÖØ-ÞЀ-Я](?:\.|(?:['’]?[^\W\d_])+)"
_RANK = r"(?:Dr|Prof|Dipl|Ing)\.? "
_PARTICLE = r"(?:(?:von|van|der|den|de|del|della|di|da|du|la|le|zu|zum|zur|y|e) ){1,3}"
# Kinds of entities and their patterns; the group ``keep`` before and ``tail`` after stay as they are.
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"),
    ("secret", r"(?i:(?P<keep_secret>\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?))(?=[A-Za-z0-9+/_\-](?:\.?[A-Za-z0-9+/_\-]){7})[A-Za-z0-9+/_\-]+(?:[.=~%!#$^*@]+[A-Za-z0-9+/_\-]+)*"),
    ("access_key", r"(?<![A-Za-z0-9])(?P<keep_access_key>AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])(?P<keep_iban>[A-Z]{2})\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)"),
    ("phone", r"(?<![\d(+-])(?P<keep_phone>\+\d{1,2}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"),
    ("intl_phone", r"(?<![\d+])(?P<keep_intl_phone>\+\d{1,2})(?:[ .-]?\d{2,4}){3,7}(?![\d-])"),
    ("name", rf"(?P<keep_name>\b(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа|г-н|г-жа)\.? )(?:{_RANK}){{0,3}}(?:{_PARTICLE})?{_WORD}(?:[ -](?:{_PARTICLE})?{_WORD})*(?!\w)"),
)
# Given names by gender and script, in lists without a common name.
NAMES = {
    "f": ["Anna", "Carla", "Clara", "Elena", "Emma", "Greta", "Helena", "Ida", "Julia", "Laura", "Lena", "Maria", "Nora", "Paula", "Sofia", "Vera"],
    "m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Jonas", "Karl", "Leo", "Lukas", "Martin", "Oskar", "Paul", "Simon", "Victor"],
    "f cyrillic": ["Алина", "Анна", "Вера", "Галина", "Дарья", "Елена", "Инна", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Юлия"],
    "m cyrillic": ["Антон", "Борис", "Вадим", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Николай", "Олег", "Павел", "Роман", "Семён", "Юрий"],
}
_FINDER = "|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS)
#: A text without any of these has no entity: one alternative or more for each pattern, no narrower than it. Checked first as most texts have none.
_HINT = r"@|\d{3}|\d\.\d|\+\d|[A-Z]{2}\d\d|\d(?:[ -]?\d){12}|(?i:passw|pwd|token|secret|key)|AKIA|ASIA|\b(?:Mrs?|Ms|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Господин|Госпожа|г-н|г-жа)\b"
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_OF = {c: a for a in _ALPHABETS for c in a}
# The letters of names that are exchanged among each other, so that a name stays pronounceable and in its script.
_SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äëïöü", "âêîôû", "çñ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "ієї"]
_NAME_OF = {c: a for lower in _SOUNDS for a in (lower, lower.upper()) for c in a}
_FORM = {a: chr(0xE000 + i) for i, a in enumerate(sorted(set(_NAME_OF.values())))}
_FIXED_WORDS = re.compile(rf"{_RANK}|{_PARTICLE}|[ -]")
_HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")


def permute(text: str, kind: str, key: bytes, fixed: Callable[[str, int], bool] = lambda text, i: False, of: dict[str, str] = _OF) -> str:
    """A keyed permutation of all texts with the same format; non-alphanumeric characters and ``fixed`` places stay.

    The variable characters are digits of a mixed-radix number; four rounds add to each half in turn a number drawn by HMAC
    from the other half and the format. Every round can be undone, so the whole is one to one.
    """
    places = [i for i, c in enumerate(text) if c in of and not fixed(text, i)]
    if not places:
        return text
    sizes = [len(of[text[i]]) for i in places]
    moving = set(places)
    form = "".join(("x" if of is _HEX else _FORM[of[c]] if of is _NAME_OF else "9aA"[_ALPHABETS.index(of[c])]) if i in moving else c for i, c in enumerate(text))
    cut = len(places) // 2
    halves = [(0, cut), (cut, len(places))] if cut else [(0, 0), (0, len(places))]

    def pack(values, a, b):
        n = 0
        for v, s in zip(values[a:b], sizes[a:b], strict=True):
            n = n * s + v
        return n

    def once(values: list[int]) -> list[int]:
        values = list(values)
        for step in range(4):
            (a, b), (c, d) = (halves[step % 2], halves[1 - step % 2])
            told = hmac.new(key, f"{kind}|{form}|{step}|{pack(values, c, d)}".encode(), hashlib.sha256).digest()
            room = 1
            for s in sizes[a:b]:
                room *= s
            n = (pack(values, a, b) + int.from_bytes(told * (1 + room.bit_length() // 200), "big")) % room
            for i in range(b - 1, a - 1, -1):
                n, values[i] = divmod(n, sizes[i])
        return values

    start = [of[text[i]].index(text[i]) for i in places]
    now = once(start)
    out = list(text)
    for i, v in zip(places, now, strict=True):
        out[i] = of[text[i]][v]
    return "".join(out)


def _ip(text: str, key: bytes) -> str:
    """A keyed permutation of all 2**32 addresses, walked on until every part has as many digits as before."""
    n = 0
    for part in text.split("."):
        n = n << 8 | int(part)
    shape = [len(p) for p in text.split(".")]
    while True:
        left, right = n >> 16, n & 0xFFFF
        for step in range(4):
            left, right = right, left ^ int.from_bytes(hmac.new(key, f"ip|{step}|{right}".encode(), hashlib.sha256).digest()[:2], "big")
        n = left << 16 | right
        parts = [str(n >> s & 255) for s in (24, 16, 8, 0)]
        if [len(p) for p in parts] == shape:
            return ".".join(parts)


def _in_blocks(text: str, kind: str, key: bytes, size: int = 128, **how) -> str:
    """:func:`permute` for texts of any length: block by block, each one's kind holding what stands before it, so it stays one to one."""
    out, seen = [], hashlib.sha256()
    for i in range(0, len(text), size):
        out.append(permute(text[i : i + size], f"{kind}|{seen.hexdigest()}" if i else kind, key, **how))
        seen.update(text[i : i + size].encode())
    return "".join(out)


def _word(word: str, given: bool, key: bytes) -> str:
    """A word of a name: a listed given name by another one of its gender and script, any other by one of the same sounds.

    The last letter of such a word stays if it is a vowel, as it tells the gender in many languages. For given names, and for all other words, the
    mapping is one to one.
    """
    ending = len(word) > 2 and word[-1] in "aeiouаеиоуыэюя"
    fixed = lambda t, i: ending and i == len(t) - 1
    if len(word) > 128:
        return _in_blocks(word, "given" if given else "name", key, of=_NAME_OF)
    if not given:
        return permute(word, "name", key, fixed, _NAME_OF)
    for names in NAMES.values():
        if word in names:  # a keyed shift of the list is one to one
            return names[(names.index(word) + 1 + int.from_bytes(hmac.new(key, names[0].encode(), hashlib.sha256).digest()[:4], "big") % (len(names) - 1)) % len(names)]
    plain = permute(word, "given", key, fixed, _NAME_OF)
    while any(plain in names for names in NAMES.values()):  # walked on until it is no listed one
        plain = permute(plain, "given", key, fixed, _NAME_OF)
    return plain


def _name(body: str, key: bytes) -> tuple[str, dict[str, tuple[str, str]]]:
    """The name with its words exchanged, and for each word its kind (given, surname) and what stands for it; ranks, particles, initials' dots
    and separators stay."""
    out, words, at, given = [], {}, 0, True
    while at < len(body):
        fixed = _FIXED_WORDS.match(body, at)
        end = fixed.end() if fixed else next((i for i in range(at, len(body)) if body[i] in " -"), len(body))
        word = body[at:end]
        if not fixed:
            out.append(_word(word, given, key))
            words.setdefault(word, ("given" if given else "surname", out[-1]))
            given = False
        else:
            out.append(word)
        at = end
    return "".join(out), words


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(text: str, key: bytes) -> str:
    """A number with a right check digit gets another such number, any other one another without."""
    at = [i for i, c in enumerate(text) if c.isdigit()]
    if _luhn("".join(text[i] for i in at)):
        out = permute(text, "card", key, lambda t, i: i == at[-1])
        digits = "".join(out[i] for i in at[:-1])
        return out[: at[-1]] + next(c for c in _ALPHABETS[0] if _luhn(digits + c)) + out[at[-1] + 1 :]
    out = permute(text, "no card", key)
    while _luhn("".join(out[i] for i in at)):
        out = permute(out, "no card", key)
    return out


def _iban_rest(text: str) -> int:
    """What the number leaves over 97, as ISO 7064 reckons it (1: right)."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _iban(text: str, key: bytes) -> str:
    """An account number with right check digits gets another such number of its country, any other one another without."""
    if _iban_rest(text) == 1 and 2 <= int(text[2:4]) <= 98:
        out = permute(text, "iban", key, lambda t, i: i < 4)
        return f"{out[:2]}{98 - _iban_rest(out[:2] + '00' + out[4:]):02d}{out[4:]}"
    out = permute(text, "no iban", key, lambda t, i: i < 2)
    while _iban_rest(out) == 1 and 2 <= int(out[2:4]) <= 98:
        out = permute(out, "no iban", key, lambda t, i: i < 2)
    return out


def surrogate(kind: str, text: str, keep: str, key: bytes) -> str:
    """The replacement of an entity; ``keep`` is its fixed beginning."""
    body = text[len(keep) :]
    if kind in ("ip", "card", "iban"):
        return {"ip": _ip, "card": _card, "iban": _iban}[kind](text, key)
    if kind == "name":
        return keep + _name(body, key)[0]
    if kind == "email":
        return keep + permute(body, kind, key, lambda t, i: i > t.rindex("."))
    if kind == "secret":  # hexadecimal secrets stay so, others walk on until they are none
        if set(body) <= _HEX.keys():
            return keep + _in_blocks(body, kind, key, of=_HEX)
        body = _in_blocks(body, kind, key)
        while set(body) <= _HEX.keys():
            body = _in_blocks(body, kind, key)
        return keep + body
    return keep + permute(body, kind, key)


class Replacer:
    """Replaces the entities of texts; one key gives the same surrogates everywhere."""

    def __init__(self, key: bytes, most_kept: int = 20_000):
        self.key, self.find, self.hint, self.kept, self.most_kept = key, re.compile(_FINDER), re.compile(_HINT), {}, most_kept

    def __call__(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The new text and its entities (kind, original, surrogate)."""
        if not self.hint.search(text):
            return text, []
        places = []  # start, end, kind, original, surrogate
        said: dict[str, tuple[str, str]] = {}  # words of names that stand after a title in this text
        for m in self.find.finditer(text):
            kind, whole = m.lastgroup, m[0]
            kind = next(k for k, _ in PATTERNS if m[k] is not None) if kind is None or kind.startswith("keep_") else kind
            keep = m.groupdict().get(f"keep_{kind}") or ""
            new = self.kept.get((kind, whole))
            if new is None:
                if len(self.kept) >= self.most_kept:
                    self.kept.clear()
                new = self.kept[kind, whole] = surrogate(kind, whole, keep, self.key)
            places.append((*m.span(), kind, whole, new))
            if kind == "name":
                for word, by in _name(whole[len(keep) :], self.key)[1].items():
                    if len(word) > 2:
                        said.setdefault(word, by)
        if said:  # the same person without the title
            again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(said, key=len, reverse=True))) + r")(?!\w)")
            taken = iter([*places, (len(text), len(text))])
            start, end, *_ = next(taken)
            for m in again.finditer(text):
                while end <= m.start() and end < len(text):
                    start, end, *_ = next(taken)
                if m.end() <= start:
                    places.append((*m.span(), said[m[0]][0], m[0], said[m[0]][1]))
            places.sort()
        out, at = [], 0
        for start, end, _, _, new in places:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [p[2:] for p in places]


def _replace(batches, key: bytes, keep: tuple[str, ...], text: str, names: tuple[str, str, str]):
    replacer = Replacer(key)
    kinds = [k for k, _ in PATTERNS] + ["given", "surname"]
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            done = [(None, []) if t is None else replacer(t) for t in part.column("_text").to_pylist()]
            found = pa.array([[{"kind": k, "original": o, "surrogate": s} for k, o, s in x] for _, x in done], pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())])))
            yield pa.RecordBatch.from_arrays([*(part.column(f"_{i}") for i in range(len(keep))), pa.array([t for t, _ in done], pa.string()), pa.array([len(x) for _, x in done], pa.int64()), pa.array([",".join(k for k in kinds if any(y[0] == k for y in x)) for _, x in done], pa.string()), found], [*keep, text, *names])


def replace(documents: DataFrame, key: str, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("n_entities", "kinds", "entities")) -> DataFrame:
    """``keep`` columns, the whole text with surrogates, n_entities, kinds and entities (kind, original, surrogate); ``names`` are the
    three new columns' names, for tables that have such columns already.

    A null text stays null and has no entities; empty and clean texts stay as they are; texts and secrets may be of any length. The key is
    a secret of the caller's: with it, the permutations can be undone. Rows are independent, and equal entities have equal surrogates in all rows, so
    repeated rows stay equal; an empty table gives none.
    """
    if not key:
        raise ValueError("surrogates need a key")
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    keep = tuple(c for c in keep if c != "text")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"text string, `{names[0]}` long, `{names[1]}` string, `{names[2]}` array<struct<kind:string,original:string,surrogate:string>>"])
    inner = documents.select(*[c.alias(f"_{i}") for i, c in enumerate(columns(keep))], F.col("text").alias("_text"))
    return inner.mapInArrow(partial(_replace, key=key.encode(), keep=keep, text="text", names=names), schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity of their kind (none, as the mappings are one to one): kind, surrogate, n."""
    each = replaced.select(F.explode("entities").alias("e")).select("e.*").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(replaced: DataFrame, entities: str = "entities") -> DataFrame:
    """``replaced`` as a written table, after a check over all rows that no surrogate stands for two entities; a collision is an error."""
    table = stage(replaced, "pii-replaced")
    found = collisions(table.select(F.col(entities).alias("entities"))).first()
    if found:
        raise RuntimeError(f"{found.n} entities of kind {found.kind} have one surrogate")
    return table
