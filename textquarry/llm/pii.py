"""Personal identifiers, disguised ones too, with their places in the source text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_arrow

#: Letters that look like a Latin one.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝкмтвнАЕОРСУХІЈЅМТВНКαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwkmtbhAEOPCYXIJSMTBHKaopviktuABEZHIKMNOPTYX", strict=True))
DASHES, SPACES, DOTS = "‐‑‒–—―−﹣", "      　", "․。．｡"
INVISIBLE = "​‌‍⁠﻿­"
#: Further ranges of characters without a width: directions, selectors, tags, the box of a keycap.
UNSEEN = ((0x034F, 0x0350), (0x061C, 0x061D), (0x180B, 0x180F), (0x200B, 0x2010), (0x202A, 0x202F), (0x2060, 0x2070), (0x20DD, 0x20E5), (0xFE00, 0xFE10), (0xE0000, 0xE0080), (0xE0100, 0xE01F0))
MORE_LOOKALIKES = dict(zip("ӏӀүҮѵҽһҺԛԜγσϲϳıɡɑօոսհցզՍՕՏ", "lIyYvehhqWyocjigaonuhgqUOS", strict=True))
SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "oh": "0", "nought": "0", "zwo": "2", "fuenf": "5",
}
#: Last parts of addresses that are written with bare words (`name at host dot org`); none is a common word.
PLAIN_ENDS = frozenset("com org net edu gov mil info biz dev app io ai co uk de fr es nl eu ca ch pt pl se dk fi jp cn br mx au nz ru".split())
#: Other last parts: all countries' and more; some are common words, so with bare words not after an ARTICLE.
MORE_ENDS = frozenset(
    "ac ad ae af ag al am ao aq ar as at aw ax az ba bb bd be bf bg bh bi bj bm bn bo bs bt bv bw by bz cc cd cf cg ci ck cl cm cr cu cv cw cx cy cz dj dm do dz "
    "ec ee eg er et fj fk fm fo ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo ke kg kh ki km kn kp kr kw ky kz "
    "la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw my mz na nc ne nf ng ni no np nr nu om pa pe pf pg ph pk pm pn pr ps pw py "
    "qa re ro rs rw sa sb sc sd sg sh si sj sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "int name pro mobi asia cat coop aero museum jobs travel tel xyz online site website tech store shop cloud email blog wiki news software digital".split()
)
KNOWN_ENDS = PLAIN_ENDS | MORE_ENDS
ARTICLES = frozenset("the a an this that these those each every any some one his her its our their your my der die das den dem ein eine le la les un une el los las una".split())
#: Digits that are other words, too: a run of less than SPELLED_DISTINCT different digits, all of them such words (`un un
#: un un`), is no number if no word before it says that one follows.
COMMON = frozenset("un uno one oh null".split())
#: Least digits of a run with spelled ones, and how many words are spelled at least if no word before it says that a number follows.
SPELLED_RUN, SPELLED_DISTINCT, SPELLED_WORDS = 7, 3, 3
#: Signs in an address that are spelled; `point` is also a common word beside the English `at`.
SIGNS = {
    **dict.fromkeys("dot punto punkt point".split(), "."),
    **dict.fromkeys("dash hyphen bindestrich tiret guion guión".split(), "-"),
    **dict.fromkeys("underscore unterstrich".split(), "_"),
}
#: Spelled @ other than `at`; no other words.
AT_WORDS = "arroba arobase arobas arrobase ät klammeraffe affenschwanz chiocciola".split()
#: Words before `at` and a host with plain dots that are no name (`contact us at example.com`).
NOT_NAMES = frozenset("me us him her them you it i we they one here there now today and or".split())
#: Words that say that a number or an address follows, and how many characters before it they are looked for.
NUMBER_CUES = re.compile(r"(?i)(?<![^\W_])(?:call|dial|ring|fax|text|sms|whatsapp|phone|telephone|tel|mobile|cell|number|no|nr|card|account|telefon|telefono|teléfono|téléphone|numéro|numero|número|nummer|handy|móvil|portable|ruf|rufe|rufen|appelez|llame|llama|llamar)(?![^\W_])")
ADDRESS_CUES = re.compile(r"(?i)(?<![^\W_])(?:e-?mails?|mails?|mailto|contact|reach|write|address|inbox|correo|courriel|kontakt|schreib\w*|adresse|contacto|contactez|escrib\w*|écri\w*|scriv\w*)(?![^\W_])")
CUE_REACH = 40


@cache
def characters() -> dict[int, str]:
    """Code point -> what it stands for: one character or none."""
    table = {ord(c): x for c, x in (LOOKALIKES | MORE_LOOKALIKES).items()}
    table |= {c: "" for a, b in UNSEEN for c in range(a, b)}
    table |= {c + i: chr(65 + i) for c in (0x1F150, 0x1F170) for i in range(26)}
    table |= {ord(c): "-" for c in DASHES} | {ord(c): " " for c in SPACES} | {ord(c): "." for c in DOTS} | {ord(c): "" for c in INVISIBLE}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if c in table:
            continue
        if unicodedata.decimal(ch, None) is not None:
            table[c] = str(unicodedata.decimal(ch))
        elif unicodedata.category(ch) in ("Zs", "Pd"):
            table[c] = " " if ch.isspace() else "-"
        elif 0xFF00 <= c < 0xFF70 or 0x1D400 <= c < 0x1D800 or 0x2460 <= c < 0x2500 or 0x2100 <= c < 0x2190 or 0x1F130 <= c < 0x1F150 or 0xFE50 <= c < 0xFE70:
            plain = unicodedata.normalize("NFKC", ch)
            if plain.isascii() and (len(plain) == 1 or 0x2460 <= c < 0x2500 and plain.isdigit()):
                table[c] = plain
    return table


#: What opens and closes a sign in brackets.
_OPEN, _CLOSE = r"[(\[{<|*]", r"[)\]}>|*]"


def _sign(bare: list[str], bracketed: list[str], open_: str = _OPEN, close: str = _CLOSE) -> str:
    """A sign that is spelled with a bare word, or in brackets."""
    return rf"\s*+{open_}\s*+(?:{'|'.join(bracketed)}|\.)\s*+{close}\s*+|\s++(?:{'|'.join(bare)})\s++"


_ALL = list(SIGNS)
_BARE = [w for w in _ALL if w != "point"]
_DOTS = [w for w in _BARE if SIGNS[w] == "."]
#: Between spelled digits: signs, at most one new line, and a word for a sign.
_GAP = r"(?:[ \t,./()\[\]|*_-]++(?:\r?\n[ \t,./()\[\]|*_-]*+)?|\r?\n[ \t,./()\[\]|*_-]*+)"
_GAP_WORDS = "dash hyphen minus slash space bindestrich tiret guion guión".split()


@cache
def _patterns() -> dict[str, re.Pattern]:
    digit = "|".join(sorted(SPELLED, key=len, reverse=True))
    # digits in figures: a group, or single ones with dots between; no part of 3.14 or 10.0.0.1
    figures = r"(?<!\d[.,:])(?:\d(?:[.,]\d(?![^\W_]))++|\d++)(?![.,:]\d)"
    unit = rf"(?:(?:double|triple){_GAP})?(?:{digit}|{figures})(?![^\W_])"
    gap = rf"{_GAP}(?:(?:{'|'.join(_GAP_WORDS)})(?![^\W_]){_GAP})?"
    octet = rf"(?:\d{{1,3}}|(?:{digit})(?:[ \t-]+(?:{digit})){{0,2}})(?![^\W_])"
    found = {
        "spelled": re.compile(rf"(?i)(?<![^\W_])(?:\+|plus[ ])?{unit}(?:{gap}{unit})+"),
        "unit": re.compile(rf"(?i)(?<![^\W_])(?:(double|triple){_GAP})?({digit}|{figures})(?![^\W_])"),
        "octet": re.compile(rf"(?i){octet}"),
        "octets": re.compile(rf"(?i)(?<![\w.]){octet}(?:(?:{_sign(_DOTS, [*_DOTS, 'point'])}|\.){octet}){{3,}}(?!\.\d)"),
        "dotted": re.compile(r"\.[a-z0-9]"),
        "dotted_digits": re.compile(rf"(?:{digit})\.(?:\d|{digit})|\d\.(?:{digit})"),
        "at": re.compile(rf"(?i){_OPEN}\s*+(?:at|{'|'.join(AT_WORDS)}|@)\s*+{_CLOSE}|@|(?<=\s)(?:at|{'|'.join(AT_WORDS)})(?=\s)|(?<=[^\W_])_++at_++(?=[^\W_])"),
        "digit": re.compile(r"[0-9]"),
        "word": re.compile(r"[^\W_]+"),
        "marks": re.compile("[\u0300-\u036f]"),
        "bracket_dot": re.compile(rf"{_OPEN}\s*\.\s*{_CLOSE}"),
        # in lower case: `at` before something like a host
        "may_at": re.compile(rf"at[\s)\]}}>|*_]++[a-z0-9-]++(?:\.[a-z0-9-]|_++dot_|{_sign(_ALL, _ALL)})"),
    }
    # of an address, by how its @ is written: signs, the host after it, the name before it (read backwards)
    for how, words in (("at", _BARE), ("clear", _ALL), ("_", [])):
        sign = _sign(words, _ALL) if words else r"_++dot_++"
        back = _sign([w[::-1] for w in words], [w[::-1] for w in _ALL], _CLOSE, _OPEN) if words else r"_++tod_++"
        name = r"[\w.+-]*[a-z0-9]" if words else r"[^\W_](?:[\w.+-]*[a-z0-9])?"
        found |= {
            f"sign {how}": re.compile("(?i)" + sign),
            f"dot {how}": re.compile(rf"(?i){sign}|\."),
            f"host {how}": re.compile(rf"(?i)\s*+([a-z0-9-]+(?:(?:{sign}|\.)[a-z0-9-]+)+)(?![\w-])"),
            f"name {how}": re.compile(rf"(?i)\s*+({name}(?:(?:{back}){name})*)(?![\w.+-])"),
        }
    return found


@cache
def _odd() -> frozenset[str]:
    return frozenset(map(chr, characters()))


def odd_characters(text: str) -> frozenset[str] | set[str]:
    """Those of the text that stand for others."""
    return frozenset() if text.isascii() else _odd().intersection(text)


@cache
def _gap_words() -> frozenset[str]:
    return frozenset(_GAP_WORDS)


def spelled_candidate(low: str) -> bool:
    """Whether enough digits, spelled ones among them, are side by side: without that the pattern can't match."""
    words = _patterns()["word"].findall(low)
    if SPELLED.keys().isdisjoint(words):
        return False
    run, times, any_ = 0, 1, False
    for word in words:
        if word in SPELLED:
            run, times, any_ = run + times, 1, True
        elif word in ("double", "triple"):
            times = 3
        elif word.isdecimal():
            run, times = run + max(len(word), times), 1
        elif word not in _gap_words():
            run, times, any_ = 0, 1, False
        if any_ and run >= SPELLED_RUN:
            return True
    return False


def may_octets(text: str, low: str) -> bool:
    p = _patterns()
    return any(w in low for w in ("dot", "punto", "punkt", "point")) or ("." in text and bool(p["bracket_dot"].search(text) or p["dotted"].search(low) and p["dotted_digits"].search(low)))


def may_address(text: str, low: str) -> bool:
    return "@" in text or any(w in low for w in AT_WORDS) or bool(_patterns()["may_at"].search(low))


@dataclass
class Normal:
    """Normalised text; of each of its characters where its source begins and ends; runs that were spelled."""

    text: str
    start: list[int] | None  # None: as in the source
    end: list[int] | None
    spelled: list[tuple[int, int]]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def cued(cues: re.Pattern, text: str, at: int) -> bool:
    """Whether one of the words stands shortly before a place."""
    return bool(cues.search(text, max(0, at - CUE_REACH), at))


def _replace(normal: Normal, cuts: list[tuple[int, int, str]]) -> Normal:
    """Puts strings in place of spans, in order; each new character stands for the whole span."""
    if not cuts:
        return normal
    start = normal.start or list(range(len(normal.text)))
    end = normal.end or list(range(1, len(normal.text) + 1))
    text, s, e, at = [], [], [], 0
    for a, b, new in [*cuts, (len(normal.text), len(normal.text), "")]:
        text.append(normal.text[at:a]), s.extend(start[at:a]), e.extend(end[at:a])
        if new:
            text.append(new), s.extend([start[a]] * len(new)), e.extend([end[b - 1]] * len(new))
        at = b
    spelled, shift, i = [], 0, 0
    for a, b in normal.spelled:
        while i < len(cuts) and cuts[i][1] <= a:
            shift += len(cuts[i][2]) - (cuts[i][1] - cuts[i][0])
            i += 1
        spelled.append((a + shift, b + shift))
    return Normal("".join(text), s, e, spelled)


def plausible(text: str, at: int, name: str) -> bool:
    """Whether bare words with an unknown last part are an address: a word before speaks of mail, or the name has
    a digit or sign inside."""
    return cued(ADDRESS_CUES, text, at) or bool(re.search(r"[0-9._+-]", name))


def named(text: str, at: int, name: str, labels: list[str]) -> bool:
    """Whether a name, `at` and a host with plain dots are an address and not prose about a site."""
    if labels[0] == "www" or name.lower() in NOT_NAMES or ADDRESS_CUES.fullmatch(name) or set(text[max(0, at - 20) : at].lower().split()[-1:]) & ARTICLES:
        return False
    known = KNOWN_ENDS if cued(ADDRESS_CUES, text, at) else PLAIN_ENDS if re.search(r"(?i)[a-z][._+][a-z]", name) else ()
    return labels[-1] in known


def characters_cuts(source: str) -> list[tuple[int, int, str]]:
    """Look-alike and invisible characters, and letters with marks of their own, composed or else without them."""
    odd, table = odd_characters(source), characters()
    marks = not source.isascii() and bool(_patterns()["marks"].search(source))
    if not odd and not marks:
        return []
    parts = (["[^\\W\\d_][\u0300-\u036f]+"] if marks else []) + (["[" + re.escape("".join(sorted(odd))) + "]"] if odd else [])
    cuts = []
    for m in re.finditer("|".join(parts), source):
        new = table.get(ord(m.group()[0]), m.group()[0])
        if m.end() > m.start() + 1:
            composed = unicodedata.normalize("NFC", new + m.group()[1:])
            new = composed if len(composed) == 1 else new
        cuts.append((m.start(), m.end(), new))
    return cuts


def octet_cuts(text: str) -> list[tuple[int, int, str]]:
    """Four numbers up to 255 with a spelled dot or digit among them."""
    p, cuts = _patterns(), []
    for m in p["octets"].finditer(text):
        shown = m.group()
        parts = ["".join(SPELLED.get(w.lower(), w) for w in p["word"].findall(x.group())) for x in p["octet"].finditer(shown)]
        value = ".".join(parts)
        if len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and value != shown:
            cuts.append((m.start(), m.end(), value))
    return cuts


def spelled_cuts(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of digits with spelled ones."""
    p = _patterns()
    for m in p["spelled"].finditer(text):
        units = []
        for u in p["unit"].finditer(text, m.start(), m.end()):
            word = u.group(2).lower()
            digits = SPELLED.get(word) or re.sub(r"\D", "", word)
            units.append((u.start(), u.end(), digits * ({"double": 2, "triple": 3}.get((u.group(1) or "").lower(), 1) if len(digits) == 1 else 1), word if word in SPELLED else ""))
        runs: list[list[tuple[int, int, str, str]]] = [[]]
        if spelled_kind("".join(u[2] for u in units)) == "card":
            runs = [units]
        else:
            for figures, same in groupby(units, lambda u: not u[3]):
                part = list(same)
                # a number in figures stands for itself
                if figures and len(part) < sum(len(u[2]) for u in part) >= SPELLED_RUN:
                    runs.append([])
                else:
                    runs[-1] += part
        for run in runs:
            digits, spelled = "".join(u[2] for u in run), [u[3] for u in run if u[3]]
            if len(digits) < SPELLED_RUN or not spelled:
                continue
            begin = m.start() if run[0][0] == units[0][0] else run[0][0]
            plus = begin < run[0][0]
            cue = plus or cued(NUMBER_CUES, text, begin)
            if cue or (len(set(digits)) >= SPELLED_DISTINCT or not COMMON.issuperset(spelled)) and SPELLED_WORDS <= len(spelled) and len(spelled) * 2 >= len(run):
                yield begin, run[-1][1], ("+" if plus else "") + digits


def _stands_for(sign: str) -> str:
    return SIGNS.get(re.sub(r"[\W_]", "", sign).lower(), ".")


def address_cuts(text: str) -> list[tuple[int, int, str]]:
    """At, dots and other signs of addresses. From each at, the host is read on and the name backwards, so that neither
    has a longest form and time stays linear."""
    p = _patterns()
    cuts: list[tuple[int, int, str]] = []
    back, last = "", 0
    for at in p["at"].finditer(text):
        sign = at.group().lower()
        how = "at" if sign == "at" else "_" if sign[0] == "_" else "clear"
        host = p[f"host {how}"].match(text, at.end()) if at.start() >= last else None
        if not host:
            continue
        back = back or text[::-1]
        name = p[f"name {how}"].match(back, len(text) - at.start(), len(text) - last)
        if not name:
            continue
        begin, stop, start = len(text) - name.end(1), len(text) - name.start(1), host.start(1)
        dots = [(d.start(), d.end(), _stands_for(d.group()), d.group().strip().isalpha()) for d in p[f"dot {how}"].finditer(text, start, host.end(1))]
        parts = [text[a:b].lower() for a, b in zip([start, *(d[1] for d in dots)], [*(d[0] for d in dots), host.end(1)])]
        # the last part is of letters; words after a bare dot belong to the host up to the last known ending, if there is one
        stops = [i for i in range(len(dots), 0, -1) if dots[i - 1][2] == "." and parts[i].isalpha() and len(parts[i]) > 1]
        if not stops:
            continue
        n = next((i for i in stops if parts[i] in KNOWN_ENDS and (i == len(dots) or dots[i][3])), stops[0])
        end = dots[n][0] if n < len(dots) else host.end(1)
        dots = dots[:n]
        labels = "".join([parts[0], *(d[2] + x for d, x in zip(dots, parts[1:]))]).split(".")
        hidden = [d[:3] for d in dots if text[d[0] : d[1]] != "."]
        local, first = [], begin
        for d in p[f"sign {how}"].finditer(text, begin, stop):
            # words before a bare dot belong to the name only if at is spelled too
            if d.group().strip().isalpha() and (sign == "@" or text[begin : d.start()].lower() in ARTICLES):
                local, first = [], d.end()
            else:
                local.append((d.start(), d.end(), _stands_for(d.group())))
            begin = d.end()
        if how == "_" and labels[-1] not in PLAIN_ENDS:
            continue
        if how == "at" and not hidden and not named(text, first, text[first:stop], labels):
            continue
        if how == "at" and hidden and labels[-1] not in PLAIN_ENDS and (labels[-2] in ARTICLES or labels[-1] not in KNOWN_ENDS and not plausible(text, first, text[first:stop])):
            continue
        cuts += local
        if text[stop:start] != "@":
            cuts.append((stop, start, "@"))
        cuts += hidden
        last = end
    return cuts


def normalise(source: str) -> Normal:
    """Transducers one after the other: look-alike characters, spelled digits, at and dot in addresses."""
    normal = Normal(source, None, None, [])
    normal = _replace(normal, characters_cuts(source))
    low = normal.text.lower()
    if may_octets(normal.text, low):
        normal = _replace(normal, octet_cuts(normal.text))
    if spelled_candidate(low):
        cuts, shift = list(spelled_cuts(normal.text)), 0
        normal = _replace(normal, cuts)
        for a, b, new in cuts:
            normal.spelled.append((a + shift, a + shift + len(new)))
            shift += len(new) - (b - a)
        low = normal.text.lower()
    if may_address(normal.text, low):
        normal = _replace(normal, address_cuts(normal.text))
    return normal


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0 and len(set(digits)) > 1


def _iban(value: str) -> bool:
    value = value.replace(" ", "").upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _digits(value: str) -> int:
    return sum(c.isdigit() for c in value)


def spelled_kind(digits: str) -> str:
    """card by checksum, phone up to the 15 digits that one can have; longer runs are numbers of some account."""
    return "card" if 13 <= len(digits) <= 19 and luhn(digits) else "phone" if len(digits) <= 15 else "number"


def _ssn(value: str) -> bool:
    a, b, c = value.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


#: Kind, pattern, group of the value, test of the value, strings (lower case) of which a text with a find has one; none: a
#: digit. Of overlapping finds the earlier kind wins.
KINDS: list[tuple[str, re.Pattern, int, Callable[[str], bool], tuple[str, ...]]] = [
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?([^\s\"']{8,})"), 1, lambda v: True, ("token", "secret", "passw", "key")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])"), 1, lambda v: True, ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")),
    ("email", re.compile(r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])"), 1, lambda v: True, ("@",)),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), 1, _iban, ()),
    ("card", re.compile(r"(?<![\w.+])(\d(?:[ -]?\d){12,18})(?!\w)"), 1, lambda v: luhn(re.sub(r"\D", "", v)), ()),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), 1, _ssn, ()),
    ("ip", re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)"), 1, lambda v: True, ()),
    ("phone", re.compile(r"(?<![\w.])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)"), 1, lambda v: 7 <= _digits(v) <= 15, ()),
    # national numbers with their leading zero, then digits in groups after a word that says so
    ("phone", re.compile(r"(?<![\w.,])(\(?0\d{1,4}\)?[ /-]\d{3,4}[ -]?\d{3,6}|0\d(?:[ .-]\d{2}){4})(?![\w,]|\.\d)"), 1, lambda v: 10 <= _digits(v) <= 11, ()),
    ("phone", re.compile(r"(?i)(?<![^\W_])(?:call|dial|fax|sms|whatsapp|phone|telephone|tel|mobile|telefon|telefono|teléfono|téléphone|handy|móvil)(?![^\W_])[^\w+(]{1,3}(?:(?:me|us|at|on|number|no|nr|is)[^\w+(]{1,2}){0,3}(\(?\d(?:[ ()./-]{0,2}\d){6,14})(?!\w)"), 1, lambda v: 7 <= _digits(v) <= 15, ()),
]


def detect(text: str) -> list[tuple[str, int, int, str, bool]]:
    """Identifiers in order: kind, start and end in the source, normalised value, whether it was disguised."""
    normal = normalise(text)
    low, digits = normal.text.lower(), bool(_patterns()["digit"].search(normal.text))
    tried = [k for k in KINDS if (any(x in low for x in k[4]) if k[4] else digits)]
    finds = [(m.start(g), m.end(g), kind) for kind, pattern, g, valid, _ in tried for m in pattern.finditer(normal.text) if valid(m.group(g))]
    finds += [(a, b, spelled_kind(normal.text[a:b].lstrip("+"))) for a, b in normal.spelled]
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(normal.text))
    for a, b, kind in finds:
        if used.find(1, a, b) < 0:
            used[a:b] = b"\1" * (b - a)
            taken.append((a, b, kind))
    out = []
    for a, b, kind in sorted(taken):
        s, e = normal.source(a, b)
        out.append((kind, s, e, normal.text[a:b], text[s:e] != normal.text[a:b]))
    return out


def identifiers(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each identifier: doc_id, kind, start, end (characters of the source), value (normalised), disguised.

    Kinds: secret, email, iban, card (by checksum), ssn, ip, phone, number (a longer spelled run); of overlapping finds
    the earlier kind stays, of one kind the earlier place. Null and empty texts
    have none; repeated rows give repeated finds; whole texts are searched, however long. Other columns aren't read. An
    empty table gives no rows. No shuffle.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) if t for x in detect(t)]
        columns = list(zip(*found)) or [()] * 6
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["doc_id", "kind", "start", "end", "value", "disguised"])

    return map_arrow(rows, run, f"doc_id {kind}, kind string, start int, end int, value string, disguised boolean")


def redact(text: str) -> str:
    """The text with [kind] in place of each identifier."""
    out, at = [], 0
    for kind, s, e, _, _ in detect(text):
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])
