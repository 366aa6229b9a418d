"""Personal details in free text: patterns propose spans, validators and context words score them.

Each pattern gives its spans a base score. Words close by raise or lower it (telephone words for a telephone number,
"version" or "lot" against any number), and so do validators. The Luhn sum of card numbers and mod 97 of IBANs must hold.
For numbers without separators, the rules of social security numbers and the mod-23 letter must hold as well; with them,
they add to the score, as do the area and exchange rules of North American numbers, since a number that the text calls by
its kind is personal even if mistyped or invented. A mailbox is told by the
syntax of its domain; a common ending raises its score, an ending that files or attributes of code have lowers it.

Names are words in the form of a full name, scored by the words before ("thanks to", "written by", "my name is", a
title) and after ("said", "lives"), by a mailbox next to them, and by given and family names that are known; words that
organisations or code are called by rule a name out. Spans that reach THRESHOLD are found.

Cheap substring tests come before each pattern, and patterns run on the lines those tests hit, so that text without
details costs little more than reading it. Texts are scanned whole; spans never overlap (the earlier, then longer, then
better scored stays). Contexts reach to the ends of the line, but no farther than NEAR characters; a detail that is
parted by a line break is not found.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
KINDS = ("email", "phone", "id_number", "address", "person")
NEAR = 80

# Letters with upper and lower case of the Latin blocks.
_U, _L = "A-ZÀ-ÖØ-ÞĀ-ſ", "a-zß-öø-ÿĀ-ſ"

# ---- mailboxes
_TLD = frozenset(
    "com org net edu gov mil int info biz io dev app ai co me tv eu example test invalid localhost local "
    "us uk de at ch fr it es pt nl be lu dk se no fi is ie pl cz sk hu ro bg gr hr si ee lv lt ru ua tr il in cn jp kr tw hk sg au nz za br ar mx cl ca".split()
)
# Endings that names in code have; they lower the score of what looks like a mailbox.
_CODE_ENDING = frozenset(
    "py pyc js jsx ts tsx mjs json md rst txt html htm css scss java kt cpp hpp cc hh go rs rb php pl sh bat ps yml yaml toml ini cfg conf lock so dll exe bin png jpg jpeg gif svg pdf csv tsv xml sql log "
    "min max map set get put add pop run call apply shape dtype size length weight weights bias value values data index item items list dict self this args kwargs method property setter getter wraps decorator "
    "tag release version beta alpha latest next main master head dev branch service target mount socket timer path".split()
)
_mail_word = re.compile(r"\b(?:e-?mails?|mail|mailto|contact|write|reach|address|inbox|from|to|cc|reply)\b\W{0,4}(?:\w+\W{1,3}){0,2}\Z", re.I)
_domain = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+([A-Za-z]{2,24})(?![\w(-]|\.\w)")
_local = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]*\Z")
_spelt = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?: ?[\[({<] ?(?:at|AT) ?[\])}>] ?| (?:at|AT) )"
    r"[A-Za-z0-9-]+(?:(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]+)*?(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| (?:dot|DOT) |\.)([A-Za-z]{2,24})(?![\w(-]| (?:dot|DOT) |\.\w|[\[(](?:dot|DOT))"
)

# ---- numbers; the second character back must not carry the number on
_intl = re.compile(r"\+(?<![\w+/=]\+)\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?![\w=/+])")
_paren = re.compile(r"\(\d{3}\) ?\d{3}[-. ]\d{4}(?![\w-]|\.\d)")
_digits = re.compile(
    r"[0-9](?<![\w.+/-].)(?:(?P<nanp>\d\d([-.])\d{3}\2\d{4})|(?P<ssn>\d\d([- ])\d\d\4\d{4})|(?P<dni>\d{7}-[A-Z])"
    r"|(?P<trunk>\d{3,4} \d{3} \d{3}|\d{3} \d{3} \d{4}|\d\d \d{4} \d{4})|(?P<card>\d{3}([ -])(?:\d{4}\8\d{4}\8\d{4}|\d{6}\8\d{5})))(?![\w=/+-]|\.\d)"
)
# digits without marks, which only a word before can tell
_bare = re.compile(r"[0-9](?<![\w.+/-].)\d{7,18}[A-Z]?(?![\w=/+-]|\.\d)")
_says_phone = re.compile(r"\b(?:tel|telephone|phone|fax|call|mobile|cell|dial|hotline|pager|whatsapp)\b[^\w\n]{0,3}(?:(?:no|number|is|at|on|us|me)\b[^\w\n]{0,3}){0,2}\Z", re.I)
_says_ssn = re.compile(r"\b(?:ssn|social security|tax id|tin|itin|national id)\b[^\w\n]{0,3}(?:(?:no|number|is)\b[^\w\n]{0,3}){0,2}\Z", re.I)
_says_card = re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pan)\b[^\w\n]{0,3}(?:(?:no|number|is|card)\b[^\w\n]{0,3}){0,2}\Z", re.I)
_says_dni = re.compile(r"\b(?:dni|nif|nie)\b[^\w\n]{0,3}(?:(?:no|number|is)\b[^\w\n]{0,3}){0,2}\Z", re.I)
_letters = re.compile(
    r"[A-Z](?<![\w.+/-].)[A-Z](?:(?P<nino>(?: ?\d\d){3} ?[A-D])|(?P<pass>\d{7})|(?P<iban>\d\d(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?))(?![\w=/+-]|\.\d)"
)
_for_phone = re.compile(r"\b(?:tel|telephone|phone|fax|call|mobile|cell|dial|hotline|pager)\b|[@;]|%40|\brecord\b", re.I)
_for_id = re.compile(
    r"\b(?:ssn|id|owner_id|passport|tax|card|national|identity|insurance|nino|dni|nif|social|licen[cs]e|iban|account|record|number)\b|[@;]|%40|, *\+?\(?\d{3}", re.I
)
_against = re.compile(r"\b(?:version|part|lot|rate|ports?|build|revision|rev|serial|sku|model|isbn|sha1|uuid|section|offset|checksum|ticket|issue)\b[^;,]{0,12}\Z", re.I)

# ---- addresses
_SUFFIX = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Court|Ct\.?|Crescent|Terrace|Drive|Dr\.?|Way|Place|Square|Close|Gardens|Grove|Row|Hill|Park|Quay)"
_NAME = rf"[{_U}][{_L}'’]+(?:[ -][{_U}][{_L}'’]+){{0,2}}"
_english = re.compile(
    rf"(?<![\w.:-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d{{1,4}}[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? {_NAME} {_SUFFIX}(?![\w])(?:, (?:Flat|Apt\.?|Apartment|Unit|Suite) \d{{1,4}}[A-Za-z]?(?!\w))?"
)
_french = re.compile(rf"(?<![\w.:-])\d{{1,5}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse)(?: (?:de|du|des|de la|d['’]))? ?{_NAME}")
_german = re.compile(rf"(?<!\w)[{_U}][{_L}-]*(?:weg|gasse|straße|strasse|allee|platz|ufer|damm|ring) \d{{1,4}}(?:[a-z](?!\w)| ?[-–] ?\d{{1,4}}(?:[a-z](?!\w))?)?(?!\w|\.\d)")
_abbreviated = re.compile(rf"(?<!\w)[{_U}][{_L}]+(?:[ -][{_U}][{_L}]+)?(?:str|pl)\. \d{{1,4}}(?:[a-z](?!\w))?(?!\w|\.\d)")
_spanish = re.compile(rf"(?<!\w)(?:Calle|Avenida|Paseo|Plaza|Via|Viale|Piazza|Corso|Rua)(?: (?:de|del|della|di|la|las|los|el|da|do|dos))* {_NAME},? (?:n[º°o]\.? ?)?\d{{1,4}}(?![\w.]\d|\w)")
_box = re.compile(r"(?<!\w)(?:P\. ?O\. ?Box|PO Box|Post Office Box|Postfach) \d{1,6}(?!\w)")
_spanish_near = ("Calle ", "Avenida ", "Paseo ", "Plaza ", "Via ", "Viale ", "Piazza ", "Corso ", "Rua ")
_english_near = ("Street", " St.", " St,", " Ave", " Road", " Rd", " Lane", " Ln", " Blvd", " Boulevard", " Court", " Ct", " Crescent", " Terrace", " Drive", " Way", " Place", " Square", " Close", " Gardens", " Grove", "Flat ", "Apt ")
_french_near = (" rue ", " avenue ", " boulevard ", " chemin ", " impasse ", " quai ", " allée ", " place ")
_german_near = ("weg ", "gasse ", "straße ", "strasse ", "allee ", "platz ", "ufer ", "damm ", "ring ")

# ---- people
_ONE = rf"(?:[OD]['’])?(?:Mc|Mac)?[{_U}][{_L}]+"
_BIG = rf"(?:[OD]['’])?[{_U}]{{2,}}"
_W = rf"(?:{_ONE}(?:-{_ONE})*|{_BIG}(?:-{_BIG})*)(?!\w)"
_I = rf"[{_U}]\."
_PART = r"(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|ter|ten|zu|zur|VAN|VON|DE|DER|DEN|DEL|DI|DA|DU|LA|LE|TER|TEN)"
_PARTS = tuple(f"{p} " for p in _PART[3:-1].split("|"))
_FULL = rf"(?:(?:{_PART} ){{0,2}}{_W}, (?:{_W}|{_I})(?: {_I})?|(?:{_W}|{_I})(?: (?:{_W}|{_I})){{0,2}}(?: {_PART}){{0,2}} {_W})"
_ORG = frozenset(
    "foundation collective software systems gmbh ag ltd inc llc llp corp corporation company co research labs lab laboratory authors author team teams group project toolkit works "
    "institute university college contributors developers maintainers society association consortium technologies technology solutions studio studios network networks union alliance partners "
    "bank agency department office committee council the all rights reserved unit grid license licence public".split()
)
# Words that begin sentences or name things in code, which no name begins with or holds.
_NO_NAME = frozenset(
    "the this that these those there here when where what why who how which while if in on at by for from with without to of and or but as is are was were be been not no yes all any each every some our your my his her its their we you he she it they "
    "please see use using used call calls returns return note warning error exception todo fixme hack new old first last next main test tests testing default public private static final class function method module package object string list array map set "
    "int integer float double boolean bool char byte long type types value values key keys file files path data base table index server client request response handler manager factory builder service controller model view config settings option options "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun today tomorrow yesterday "
    "python java javascript linux windows mac unix gnu apache mit bsd gpl lgpl mozilla google microsoft github gitlab docker kubernetes spark hadoop sql http https json xml html css api url uri utf ascii ieee iso rfc "
    "street avenue road lane boulevard north south east west city country state states united kingdom america europe dear hello hi regards sincerely thanks thank section chapter figure part version january "
    "copyright license licence software general public foundation open source code based create created update updated add added remove removed fix fixed ask tell contact reported written".split()
)
_BEFORE = [
    # (substring, pattern that ends where the name begins, score)
    (("hanks to ", "hank you, ", "hanks, ", "redit to ", "redits to ", "udos to "), re.compile(r"\b(?:[Tt]hanks(?: go)? to|[Tt]hank you,|[Tt]hanks,|[Cc]redits?(?: go)? to|[Kk]udos to) \Z"), 0.8),
    (("author ", "author: ", "uthor: ", "uthors: ", "aintainer: ", "aintainers: ", "wner: ", "ontributor: ", "reator: ", "ditor: "), re.compile(r"(?:@author:?|\b(?:[Aa]uthors?|[Mm]aintainers?|[Oo]wners?|[Cc]ontributors?|[Cc]reators?|[Ee]ditors?):) \Z"), 0.8),
    (("-by: ",), re.compile(r"\b[A-Z][a-z]+(?:-[a-z]+)*-by: \Z"), 0.8),
    (("TODO(", "FIXME(", "XXX(", "HACK(", "NOTE("), re.compile(r"\b(?:TODO|FIXME|XXX|HACK|NOTE)\(\Z"), 0.8),
    ((" by ", " By "), re.compile(r"\b(?:\w+ed|written|drawn|shown|seen|given|taken|led|made|built|found|sent|run|done|known)(?: in| out| up| on)? [Bb]y \Z"), 0.6),
    (("Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Miss ", "Mx ", "Mx. ", "Dr ", "Dr. ", "Prof ", "Prof. ", "Professor "), re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor)\.? \Z"), 0.8),
    (("Ask ", "ask ", "Contact ", "contact ", "Tell ", "tell ", "Ping ", "ping ", "Call ", "call ", "Email ", "email ", "Phone ", "phone ", "Notify ", "notify ", "Meet ", "meet "), re.compile(r"(?:^|[\s(\"'*#/])(?:[Aa]sk|[Cc]ontact|[Tt]ell|[Pp]ing|[Cc]all|[Ee]mail|[Pp]hone|[Nn]otify|[Mm]eet) \Z"), 0.6),
    ((" of ",), re.compile(r"\b(?:mobile|phone|number|e?mail|account|address|record|signature|office|home|birthday|file|name) of \Z"), 0.8),
    (("owner",), re.compile(r"\bowner(?:_id)?\s?[=:]\s?[^#\n]{4,20}# \Z"), 0.8),
    (("record: ", "atient: ", "mployee: ", "ustomer: ", "lient: ", "From: ", "To: ", "Cc: ", "ttn: ", "igned: ", "eviewer: ", "ssignee: "), re.compile(r"\b(?:record|[Pp]atient|[Ee]mployee|[Cc]ustomer|[Cc]lient|From|To|Cc|[Aa]ttn|[Ss]igned|[Rr]eviewer|[Aa]ssignee): \Z"), 0.7),
    (("name is ", "I am ", "I'm ", "named ", "Dear ", "egards, ", "incerely, ", "aithfully, ", "his is ", "on behalf of ", "ccording to ", "ourtesy of ", "peak with ", "peak to ", "alk to ", "alked to "), re.compile(r"\b(?:name is|I am|I'm|named|Dear|[Rr]egards,|[Ss]incerely,|faithfully,|[Tt]his is|on behalf of|[Aa]ccording to|[Cc]ourtesy of|[Ss]peak (?:with|to)|[Tt]alk(?:ed)? to) \Z"), 0.7),
    (("name",), re.compile(r"[\"']?\b(?:full_?)?name[\"']?\s?[:=]\s?[\"']\Z"), 0.7),
]
_AFTER = re.compile(
    r"(?<=[a-zß-ÿ.]) (?:said|says|wrote|writes|noted|reported|fixed|suggested|asked|replied|mentioned|proposed|maintains|approved|reviewed|submitted|explained|confirmed|signed|phoned|joined|lives|works|owns|pointed out|told|will be|can be reached)\b"
)
_AFTER_NEAR = (" said", " says", " wrote", " writes", " noted", " reported", " fixed", " suggested", " asked", " replied", " mentioned", " proposed", " maintains", " approved", " reviewed", " submitted", " explained", " confirmed", " signed", " phoned", " joined", " lives", " works", " owns", " pointed out", " told", " will be", " can be reached")
_title = re.compile(r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Lady|Captain|Doctor)\.? (?=\w+\.? \w)")
_dated = re.compile(rf"[0-9]\d{{3}}-\d\d-\d\d ({_FULL}):")
_holder = re.compile(rf"Copyright (?:\(c\)|\(C\)|©)?,? ?(?:\d{{4}}(?:-\d{{4}})?,? )?({_FULL})(?=[ \t]*(?:[\r\n\"'*,;<(]|\\n|$))")
_ends = re.compile(rf"(?<![\w’-])(?<!\w')({_FULL})\Z")
_near_mail = re.compile(rf"(?<![\w’-])(?<!\w')({_FULL})(?:[;\t|]|, ?| ?[<(])\Z")
_maintainers = re.compile(r"\b(?:Maintainers?|Owners?|Reviewers?|Contributors?): ")
_full = re.compile(_FULL)
_pair = re.compile(rf"(?<!\w)([{_U}][{_L}'’-]+) ([{_U}][\w'’-]+)")
_follow = re.compile(r" and |, and |; ?|, | & ")


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of 10."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN leaves 1 by mod 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


# The check letters of Spanish national numbers, by the number mod 23.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _line(text: str, a: int) -> tuple[int, int]:
    end = text.find("\n", a)
    return text.rfind("\n", 0, a) + 1, len(text) if end < 0 else end


def _lines(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bounds of the lines that hold one of the marks (start, end), each once, in order."""
    out, end = [], -1
    for a, _ in sorted(hits):
        if a > end:
            out.append(_line(text, a))
            end = out[-1][1]
    return out


_SPELT_NEAR = ("dot ", "DOT ", "at]", "at)", "AT]", "AT)", "at}", "at>", "AT}", "AT>", "at ]", "at )", "AT ]", "AT )")
_ADDRESSES = [
    (_english_near, _english), (_french_near, _french), (_german_near, _german), (("str. ", "pl. "), _abbreviated), (_spanish_near, _spanish), (("Box ", "Postfach "), _box),
]
_GROUPS = {
    "at": ("@", "%40"), "spelt": _SPELT_NEAR, "after": _AFTER_NEAR, "copyright": ("Copyright",), "list": ("aintainer", "wner", "eviewer", "ontributor"),
    **{("address", k): marks for k, (marks, _) in enumerate(_ADDRESSES)}, **{("before", k): marks for k, (marks, *_) in enumerate(_BEFORE)},
}
_marks = ahocorasick.Automaton()
for _m in {m for marks in _GROUPS.values() for m in marks}:
    _marks.add_word(_m, (len(_m), [g for g, marks in _GROUPS.items() if _m in marks]))
_marks.make_automaton()


def _hits(text: str) -> dict:
    """Where the marks of each group stand, all found in one pass."""
    out: dict = {}
    for last, (n, groups) in _marks.iter(text):
        for g in groups:
            out.setdefault(g, []).append((last + 1 - n, last + 1))
    return out


def _before(text: str, a: int) -> str:
    return text[max(text.rfind("\n", 0, a) + 1, a - NEAR) : a]


def _context(text: str, a: int, b: int, good: re.Pattern) -> float:
    before = _before(text, a)
    after = text[b : b + 24].split("\n", 1)[0]
    score = 0.3 if good.search(before) or good.search(after) else 0.0
    if _against.search(before[-24:]) or re.match(r" ?(?:per|ms|px|bytes?)\b", after):
        score -= 0.6
    return score


def ssn(digits: str) -> bool:
    """Whether area, group and serial of a social security number can be issued."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def mod23(dni: str) -> bool:
    return _DNI[int(dni[:8]) % 23] == dni[-1]


def _numbers(text: str, out: list) -> None:
    if "+" in text:
        for m in _intl.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone", 0.6 + _context(text, *m.span(), _for_phone)))
    for m in _paren.finditer(text):
        out.append((*m.span(), "phone", 0.6 + _context(text, *m.span(), _for_phone)))
    for m in _digits.finditer(text):
        a, b, kind, s = *m.span(), m.lastgroup, m[0]
        if kind == "nanp":
            real = s[0] > "1" and s[4] > "1"
            out.append((a, b, "phone", (0.4 if s[3] == "-" else 0.25) + 0.1 * real + _context(text, a, b, _for_phone)))
        elif kind == "trunk":
            if s[0] == "0":
                out.append((a, b, "phone", 0.45 + _context(text, a, b, _for_phone)))
        elif kind == "card":
            if luhn(re.sub(r"\D", "", s)):
                out.append((a, b, "id_number", 0.4 + _context(text, a, b, _for_id)))
        elif kind == "ssn":
            out.append((a, b, "id_number", 0.2 + 0.1 * ssn(re.sub(r"\D", "", s)) + _context(text, a, b, _for_id)))
        else:
            out.append((a, b, "id_number", 0.4 + 0.2 * mod23(s) + _context(text, a, b, _for_id)))
    for m in _letters.finditer(text):
        if m.lastgroup == "iban" and not mod97(m[0].replace(" ", "")):
            continue
        out.append((*m.span(), "id_number", 0.4 + _context(text, *m.span(), _for_id)))
    for m in _bare.finditer(text):
        s, before = m[0], _before(text, m.start())
        n = len(s)
        if s[-1].isalpha():
            sure = n == 9 and mod23(s) and _says_dni.search(before)
        elif n >= 13:
            sure = luhn(s) and _says_card.search(before)
        elif n == 9:
            sure = ssn(s) and _says_ssn.search(before)
        else:
            sure = n in (10, 11) and s[-10] > "1" and s[-7] > "1" and _says_phone.search(before)
        if sure:
            out.append((*m.span(), "phone" if n in (10, 11) else "id_number", 0.7))


def _mails(text: str, hits: dict, out: list) -> None:
    for i, at in hits.get("at", ()):
        m = _domain.match(text, at)
        if m and (n := _local.search(text, max(text.rfind("\n", 0, i) + 1, i - NEAR), i)):
            end, after = m[1], text[m.end() : m.end() + 40]
            remote = after[:1] == ":" and re.match(r":[\w~./-]*[a-z/]", after)
            score = 0.9 if end.lower() in _TLD else 0.2 if end.lower() in _CODE_ENDING or not end.islower() or len(end) < 3 else 0.45
            if score < 0.9:
                score += 0.3 * bool(_mail_word.search(_before(text, n.start()))) + 0.2 * (text[n.start() - 1 : n.start()] == "<" and after[:1] == ">")
            if not remote:
                out.append((n.start(), m.end(), "email", score))
    for lo, hi in _lines(text, hits.get("spelt", ())):
        for m in _spelt.finditer(text, lo, hi):
            if m[1].lower() in _TLD:
                out.append((*m.span(), "email", 0.8))


def _addresses(text: str, hits: dict, out: list) -> None:
    for k, (_, pattern) in enumerate(_ADDRESSES):
        for lo, hi in _lines(text, hits.get(("address", k), ())):
            out.extend((*m.span(), "address", 0.8) for m in pattern.finditer(text, lo, hi))


def _words(name: str) -> list[str]:
    return [w.strip(".").lower() for w in re.split(r"[ ,]+", name)]


def _names(text: str, hits: dict, mails: list, out: list, known: frozenset[str]) -> None:
    """known: lower-case given and family names."""

    def add(a: int, b: int, score: float) -> None:
        each = _words(text[a:b])
        if _ORG.isdisjoint(each) and (score >= 0.8 or _NO_NAME.isdisjoint(each)):
            out.append((a, b, "person", score + 0.3 * (not known.isdisjoint(each))))

    for k, (marks, pattern, score) in enumerate(_BEFORE):
        for i, at in hits.get(("before", k), ()):
            if marks[0] in ("owner", "name"):
                # the name follows a sign and a quote, or a comment
                lo, hi = _line(text, i)
                for m in _full.finditer(text, at, min(hi, at + 60)):
                    if pattern.search(text[lo : m.start()]) and (marks[0] == "owner" or text[m.end() : m.end() + 1] in "\"'"):
                        add(*m.span(), score)
                        break
            elif text[at : at + 1].isupper() or text.startswith(_PARTS, at):
                m = _full.match(text, at)
                if m and pattern.search(text[max(text.rfind("\n", 0, at) + 1, at - 40) : at]):
                    add(*m.span(), score)
    for lo, hi in _lines(text, hits.get("after", ())):
        for v in _AFTER.finditer(text, lo, hi):
            m = _ends.search(text, max(lo, v.start() - NEAR), v.start())
            if m:
                title = _title.match(m[1])
                add(m.start(1) + (title.end() if title else 0), m.end(1), 0.6)
    for lo, hi in _lines(text, hits.get("copyright", ())):
        for m in _holder.finditer(text, lo, min(len(text), hi + 1)):
            add(*m.span(1), 0.8)
    for m in _dated.finditer(text) if ":" in text else ():
        add(*m.span(1), 0.8)
    for lo, hi in _lines(text, hits.get("list", ())):
        for m in _maintainers.finditer(text, lo, hi):
            at = m.end()
            while n := _full.match(text, at):
                add(*n.span(), 0.8)
                link = _follow.match(text, n.end())
                if not link:
                    break
                at = link.end()
    for a, *_ in mails:
        m = _near_mail.search(text, max(text.rfind("\n", 0, a) + 1, a - NEAR), a)
        if m:
            add(*m.span(1), 0.8)
    if known:
        for m in _pair.finditer(text):
            if m[1].lower() in known and m[2].lower() in known and (n := _full.match(text, m.start())):
                add(*n.span(), 0.5)


def find(text: str | None, known: frozenset[str] = frozenset()) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) in order, without overlaps. A null or empty text has none. known: lower-case
    given and family names, if there are any; they add to scores, and two of them in a row are a name anywhere."""
    if not text:
        return []
    got: list[tuple[int, int, str, float]] = []
    hits = _hits(text)
    _mails(text, hits, got)
    mails = sorted(x for x in got if x[3] >= THRESHOLD)
    _numbers(text, got)
    _addresses(text, hits, got)
    _names(text, hits, mails, got, known)
    out: list[tuple[int, int, str, float]] = []
    for x in sorted({x for x in got if x[3] >= THRESHOLD}, key=lambda x: (x[0], -x[1], -x[3])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; all else stays as it is."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, kind, _ in find(text):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def details(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, pii_text, times, score): one row per distinct detail of a document, as written there."""

    def scan(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen: dict[tuple[str, str], list] = {}
                for a, z, kind, score in find(t):
                    x = seen.setdefault((kind, t[a:z]), [0, 0.0])
                    x[0] += 1
                    x[1] = max(x[1], score)
                rows += [(i, k, s, n, v) for (k, s), (n, v) in seen.items()]
            cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "pii_text", "times", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, "doc_id bigint, kind string, pii_text string, times int, score double")


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with typed placeholders for what details() finds; null texts stay null."""

    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, "doc_id bigint, text string")
