"""Personal data: detection, and keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.llm.common import Scratch, documents, small_batches, task

KEY = b"ratefield surrogate key 1"

# Given names by script and gender. Each list is permuted within itself.
GIVEN = {
    ("latin", "f"): "Aisha Alice Ana Anna Barbara Camila Carmen Charlotte Chiara Claire Elena Elizabeth Emma Eva Fatima Giulia Hannah Helen Ingrid Isabel Jane Jessica Julia Karen Laura Leila Linda Lucia Maria Marie Mary Mei Monica Nancy Olivia Patricia Paula Petra Priya Rosa Sarah Sofia Sophie Susan Teresa Ursula Victoria Yuki Zoë".split(),
    ("latin", "m"): "Ahmed Albert Andrew Antonio Arjun Bernard Carlos Charles Daniel David Diego Edward Eric Francis Frank George Hans Henry Hiroshi Ibrahim Jack James Jean John Joseph Juan Karl Kenji Lars Luca Lukas Manuel Marco Mark Martin Michael Miguel Mohammed Omar Otto Paul Pedro Peter Pierre Raj Richard Robert Stefan Sven Thomas Wei William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Αθηνά Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
# Family names that tell a run of capitalised words as a name, and family names of one Han character.
FAMILY = "Brown Chen Cohen Davies Diaz Dubois Fernández Fischer García Gonzalez González Hassan Hernández Johnson Jones Khan Kim Kowalski Kumar Lee López Martínez Meyer Miller Müller Nguyen Novak O'Brien Patel Pérez Rodríguez Rossi Sánchez Schmidt Schneider Silva Singh Smith Suzuki Tanaka Taylor Wang Weber Williams Wilson Yamamoto Zhang".split()
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
TITLES = {"f": ("Mrs", "Ms", "Miss", "Mme", "Frau", "Sra", "Señora", "Madame"), "m": ("Mr", "Monsieur", "Herr", "Sr", "Señor"), "": ("Dr", "Prof", "Professor", "Sir", "Dame")}
PARTICLES = "van von der den de del della di da dos du la le el al bin ibn ten ter zu".split()
CUES = ("name is", "named", "called", "met", "contact", "Contact", "signed by", "Signed by", "written by", "Dear", "Sincerely,", "Regards,")
# Words that begin a sentence and are no part of a name; after the first ones a name is expected.
STARTERS = "Dear Contact Hello Hi Then The This That These Those When While After Before And But So If In On At By To From For With As It He She We They You Our My His Her Their Yesterday Today Tomorrow Meanwhile Now Here There Also Not Is Was Are Did Does Has Had Have Will Would Can Could Should Since Although Because However Once Only Even Both Every Each Some Many Most All No Yes Please Thanks Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
_ADDRESS = {"Dear", "Contact", "Hello", "Hi"}
# What persons do, said right after a name.
VERBS = "said says wrote writes told tells asked asks called calls met meets born died dies lives lived works worked joined resigned argued argues explained explains added adds replied replies visited visits thinks thought believes knew knows went came sang sings painted composed plays played married moved arrived left signed agreed announced claimed denied wants wanted loves loved teaches taught sagte schrieb meinte fragte wohnt arbeitet dit écrivit écrit habite travaille dijo escribió vive trabaja nació сказал сказала написал написала родился родилась живёт живет работает".split()
# Words of places, firms, books and rules; a run that holds one is no person.
THINGS = "Bridge Zoo Airport University College School Institute Academy County City Town Village State Province District Republic Kingdom Union States Street Road Avenue Lane Square Park Garden Gardens River Lake Mountain Mountains Mount Valley Island Islands Bay Beach Coast Sea Ocean Desert Forest Falls Station Tower Hall House Castle Palace Church Cathedral Temple Museum Gallery Library Theatre Theater Hospital Clinic Hotel Inn Center Centre Stadium Arena Bank Group Company Corporation Corp Inc Ltd LLC GmbH AG Industries Controls Systems Technologies Software Solutions Partners Holdings Airlines Motors Records Press Times Post Journal Tribune News Magazine Foundation Association Society Council Committee Commission Agency Department Ministry Bureau Office Court Army Navy Force League Cup Prize Award Act Law Treaty License Licence Version Edition Chapter Bible Gospel Testament Symphony War Revolution Empire Dynasty Day Week Festival Games Project Program Programme Protocol Theorem Syndrome Disease Effect Method Standard International National Federal American British French German Spanish Italian Russian Chinese Japanese European African Asian Public General Strasse Straße Platz Brücke Universität Bahnhof Rue Place Pont Plaza Calle".split()
_THING = frozenset(w.lower() for w in THINGS)
# Words that begin the names of places and works.
PLACES = frozenset("New San Santa Los Las Saint St Sao São North South East West Northern Southern Eastern Western Great Grand Little Upper Lower Old Port Fort Cape Costa Puerto Buenos Rio Mount Lake Hong Kuala Abu Tel Addis Sierra Sri Cote Côte Le La Les Der Die Das Ein Eine Und Et Y The A An Of".split())
#: Right before a run: it is a place or a thing.
_WHERE = frozenset("in at near into across inside outside via through the a an this that these of der die das dem den des ein eine im am zum zur bei nach le la les un une au aux à dans chez du el los las una en del al".split())
#: The letters of a script that stand for one another: vowels, consonants, and both with marks.
LETTERS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåāăąæèéêëēėęěìíîïīįòóôõöøōőœùúûüūůűųýÿ", "çćčďđðğłñńňřßśšşťþţźżž", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώϊϋ", "βγδζθκλμνξπρςστφχψ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي")
_CLASS = {c: i for i, letters in enumerate(LETTERS) for c in letters}
HAN = (0x4E00, 0x9FA5)
#: Endings that tell the gender of a name; a word keeps its longest one.
ENDINGS = tuple(sorted("а я ова ева ина ына ая яя ская цкая ов ев ин ын ий ой ский цкий ович евич ьич овна евна ична ος ης ας ου η α a".split(), key=len, reverse=True))
#: Domains that stand for no one are left as they are; others get a surrogate below the reserved one.
RESERVED = "example.com"
# Reserved networks of the address space, as numbers and bits.
RESERVED_NETS = [(sum(int(p) << 24 - 8 * i for i, p in enumerate(n.split("."))), b) for n, b in (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3))]
_OF_NAME = {n: k for k, names in GIVEN.items() for n in names}

EMAIL = r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
IP = r"(?<![\d.])(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\d]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
CARD = r"(?<![\dA-Za-z])(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])"
SSN = r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
PHONE = r"(?<![\dA-Za-z])(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ -]\d{2,4}){2,4}|\+\d{8,14}|\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z]|\.?\d)"
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĪĮŁŃŇŌŐŒŘŚŠŞŤŢŪŮŰŲŹŻŽА-ЯЁΑ-ΩΆ-Ώ", "a-zß-öø-ÿāăąćčďđēėęěğīįłńňōőœřśšşťţūůűųźżžа-яёα-ωά-ώ"
_ONE = rf"[{_UPPER}](?:[{_LOWER}]+|[{_UPPER}]+(?![{_LOWER}])|['’][{_UPPER}][{_LOWER}]+)(?:[{_UPPER}][{_LOWER}]+)?"
_WORD = rf"{_ONE}(?:-{_ONE})*"
_NEXT = rf"(?: (?:[{_UPPER}]\. )*(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD})"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_CUE = "|".join(rf"(?<=\b{re.escape(c)} )" for c in CUES)
#: After a title or a cue; initials and a word; or a run of capitalised words, which is looked at further (name_at).
NAME = rf"(?<!\w)(?:(?:{_TITLE})\.? (?P<titled>(?:[{_UPPER}]\. )*{_WORD}{_NEXT}{{0,2}})|(?:{_CUE})(?P<cued>{_WORD}{_NEXT}{{1,3}})|(?P<initials>(?:(?<=\b[Bb]y )[{_UPPER}]\. ?|[{_UPPER}]\. ?[{_UPPER}]\. ?){_WORD})|(?P<run>{_WORD}{_NEXT}{{1,3}}))(?!\w)"
_HAN = r"\u4e00-\u9fa5"
#: A family name and one or two characters alone; more before a form of address or after a word of naming; then two Arabic words likewise.
HAN_NAME = rf"(?<![{_HAN}])(?P<han>[{HAN_FAMILY}][{_HAN}]{{1,2}})(?![{_HAN}])|(?<![{_HAN}])(?P<hantitled>[{_HAN}]{{2,4}}?)(?=先生|女士|小姐|教授|老师|さん|様|氏)|(?<=叫|名)(?P<hancalled>[{HAN_FAMILY}][{_HAN}]{{1,2}})(?=[，。、；！？,.\s]|$)"
ARABIC_NAME = r"(?:(?<=السيد )|(?<=السيدة )|(?<=الدكتور )|(?<=اسمي )|(?<=اسمه ))(?P<arabic>[\u0620-\u064a]{2,}(?: [\u0620-\u064a]{2,})?)(?!\w)"
_PLAIN = (EMAIL, IP, IBAN, CARD, SSN, PHONE)
ENTITY, WITH_NAMES = re.compile("|".join(_PLAIN)), re.compile("|".join((*_PLAIN, NAME, HAN_NAME, ARABIC_NAME)))
#: "number": digits in a card's form whose check digit doesn't hold, as orders and accounts have.
KINDS = ("email", "ip", "iban", "card", "number", "ssn", "phone", "name")
#: What a text must hold to be searched for numbers; and for names: a known word, a cue, initials, two capitalised words or Han or Arabic characters.
_HINT = re.compile(r"\d[\d .()-]{5}|[A-Z]{2}\d\d")
_TOKEN = re.compile(rf"[{_UPPER}][\w'’]+")
_MORE = re.compile(rf"(?<!\w)[{_UPPER}]\. ?[{_UPPER}]|[\u4e00-\u9fa5\u0620-\u064a]|[{_UPPER}][{_LOWER}'’-]+ (?:[a-z]{{2,3}} ){{0,2}}[{_UPPER}][{_LOWER}]|\b(?:{'|'.join(map(re.escape, CUES))}) [{_UPPER}]")
#: Endings of patronymics and of family names that a given name or a patronymic goes with.
_PATRONYM = re.compile(r"[а-яё](?:ович|евич|овна|евна|ична)$")
_FOLDED = {n.lower() for n in (*_OF_NAME, *FAMILY)}
_NAME_TOKENS = _FOLDED | {t.lower() for ts in TITLES.values() for t in ts}
_PART = re.compile(r"[ \-'’.]+|[^ \-'’.]+")
_LETTERS = tuple(frozenset(x) for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


#: Words of German, where every noun is a capitalised one.
_GERMAN = re.compile(r"\b(?:und|der|die|das|nicht|ist|mit|von|zu|ein|eine|für)\b")
_BEFORE = re.compile(r"(?:^|[.!?:;\n\"“(]\s*|[^\w\s]\s)$")
_ENDED = re.compile(r"[.!?]\s$")
_LAST = re.compile(r"(\w+),? $")
_FIRST = re.compile(r"[,]? (\w+)")


def name_at(text: str, lo: int, hi: int, german: bool) -> int | None:
    """Where the name in a run of capitalised words begins, counted from the run's beginning; None if there is none.

    Words that begin sentences are passed over. A run that holds a word of things (places, firms, rules), or a word twice,
    is no person. The rest is one if it has a known name or a patronymic; else, of two words or more, if it follows a word
    of address, or is followed by what a person does, or by a possessive; else if it stands amid a sentence, not after an
    article or a word of place, in a language that doesn't capitalise its nouns, and doesn't begin as places do.
    """
    words = text[lo:hi].split(" ")
    first = 0
    while first < len(words) - 1 and words[first] in STARTERS:
        first += 1
    rest = words[first:]
    low = [w.lower() for w in rest]
    if len(set(low)) < len(low) or not _THING.isdisjoint(low):
        return None
    at = sum(len(w) + 1 for w in words[:first])
    if any(w in _FOLDED or any(p in _FOLDED for p in w.split("-")) or _PATRONYM.search(w) for w in low) or first and words[first - 1] in _ADDRESS and len(rest) > 1:
        return at
    proper = [w for w in rest if w not in PARTICLES]
    if len(proper) < 2 or len(proper) > 3 or rest[0] in PLACES or any(w.isupper() or len(w) < 3 for w in proper):
        return None
    after = _FIRST.match(text, hi)
    if after and after[1] in VERBS or re.match(r"['’]s\b", text[hi : hi + 3]):
        return at
    if german or first or _BEFORE.search(text, max(0, lo - 8), lo):
        # a sentence's first word is capitalised whatever it is; a starter before the run leaves two words that aren't
        return at if first and not german and words[first - 1].lower() not in _WHERE else None
    before = _LAST.search(text, max(0, lo - 30), lo)
    return at if before and before[1][0].islower() and before[1] not in _WHERE else None


class Permutation:
    """Keyed permutations of 0 .. size-1 without a fixed point, so that distinct entities stay distinct and none stays itself.

    A Feistel network (HMAC-SHA256 as round function) on the next larger square, walked until it falls in range. It is
    a bijection, which makes collisions impossible within a domain; fixed points move on to the next one, in a cycle,
    when the domain is small enough to list, and else by a shift of half the range after the network.
    """

    def __init__(self, key: bytes):
        self.key = key
        self.lists: dict[tuple[str, int], list[int]] = {}

    def _round(self, domain: str, i: int, x: int, size: int) -> int:
        """A keyed number 128 bits wider than a half of the domain, so that its remainder is even over the half."""
        message = f"{domain}:{i}:{x}:{size}".encode()
        wanted = (size.bit_length() + 15) // 16 + 16
        out = b"".join(hmac.digest(self.key, message + b":%d" % k, "sha256") for k in range(-(-wanted // 32)))
        return int.from_bytes(out[:wanted], "big")

    def _network(self, domain: str, x: int, size: int) -> int:
        side = math.isqrt(size - 1) + 1
        while True:
            a, b = divmod(x, side)
            for i in range(6):
                a, b = b, (a + self._round(domain, i, b, size)) % side
            x = a * side + b
            if x < size:
                return x

    def of(self, domain: str, x: int, size: int) -> int:
        if size < 2:
            return x
        if size <= 4096:
            if (domain, size) not in self.lists:
                # one cycle through all, in keyed order: no fixed points
                order = sorted(range(size), key=lambda i: (self._round(domain, 9, i, size), i))
                to = [0] * size
                for i, j in zip(order, order[1:] + order[:1], strict=True):
                    to[i] = j
                self.lists[(domain, size)] = to
            return self.lists[(domain, size)][x]
        y = self._network(domain, x, size)
        # p^-1(p(x) + 1): conjugate to a shift by one, so it is one cycle
        return self._inverse(domain, (y + 1) % size, size)

    def _inverse(self, domain: str, y: int, size: int) -> int:
        side = math.isqrt(size - 1) + 1
        while True:
            a, b = divmod(y, side)
            for i in reversed(range(6)):
                a, b = (b - self._round(domain, i, a, size)) % side, a
            y = a * side + b
            if y < size:
                return y


def luhn_digit(digits: str) -> str:
    """The digit that completes a card number."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def is_card(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{98 - number % 97:02d}"


class Surrogates:
    """Replacements of entities. The same entity, in its canonical form, gets the same one everywhere; different ones get different ones.

    Letters, digits and the signs between them keep their places and classes (case, script, length). The canonical forms
    of one output format are a finite set, which one keyed permutation maps onto itself; what must hold of a form (a
    check digit, an address's parts up to 255, a number that can be given out) holds of its surrogate, and what doesn't
    hold doesn't. Canonical forms: an address in lower case, a telephone number without country and trunk signs, a
    number's digits, a name's words without regard to case.
    """

    def __init__(self, key: bytes = KEY):
        self.permute = Permutation(key)
        self.seen: dict[tuple[str, str], tuple[str, str, str]] = {}

    def of(self, kind: str, value: str) -> tuple[str, str, str]:
        """The surrogate of an entity, and the canonical forms of the entity and of the surrogate."""
        k = (kind, value)
        if k not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            new = getattr(self, kind)(value)
            self.seen[k] = (new, self.canonical(kind, value), self.canonical(kind, new))
        return self.seen[k]

    @staticmethod
    def canonical(kind: str, value: str) -> str:
        if kind == "phone":
            before, national = Surrogates._national(value)
            # numbers without a country's code in three and seven digits are of the country 1
            country = re.match(r"\+(\d{1,3})[ .(-]", value)
            return national if not country or country[1] == "1" else f"{country[1]}:{national}"
        if kind in ("email", "name"):
            return value.lower()
        return value if kind == "ip" else re.sub(r"[^A-Za-z0-9]", "", value)

    def digest(self, kind: str, canonical: str) -> int:
        """A keyed number of 63 bits that stands for a canonical form."""
        return int.from_bytes(hmac.digest(self.permute.key, f"entity:{kind}:{canonical}".encode(), "sha256")[:8], "big") >> 1

    def _shape(self, domain: str, value: str, keep: int = 0) -> str:
        """A string of the same shape: a number over the alphabets of its characters, permuted; the first `keep` letters and digits stay."""
        alphabets, places = [], []
        for i, c in enumerate(value):
            for letters, chars in zip(_LETTERS, ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), strict=True):
                if c in letters:
                    places.append(i)
                    alphabets.append(chars)
        kept, places, alphabets = places[:keep], places[keep:], alphabets[keep:]
        signs = "".join(c if i not in set(places) else "_" for i, c in enumerate(value)) if len(places) < len(value) else ""
        shape = "".join("9aA"["0aA".index(chars[0])] for chars in alphabets) + "".join(value[i] for i in kept) + "|" + signs
        x, size = 0, 1
        for i, chars in zip(places, alphabets, strict=True):
            x, size = x * len(chars) + chars.index(value[i]), size * len(chars)
        x = self.permute.of(f"{domain}:{shape}", x, size)
        out = list(value)
        for i, chars in zip(reversed(places), reversed(alphabets), strict=True):
            x, d = divmod(x, len(chars))
            out[i] = chars[d]
        return "".join(out)

    @staticmethod
    def _cased(new: str, like: str) -> str:
        """new, of the same length, with capitals where `like` has them."""
        return "".join(a.upper() if b != b.lower() else a for a, b in zip(new, like, strict=True))

    def email(self, value: str) -> str:
        local, _, host = value.rpartition("@")
        low = host.lower()
        new = self._cased(self._shape("email@" + low, local.lower()), local)
        if low == RESERVED or low.endswith("." + RESERVED):
            return f"{new}@{host}"
        # a host's own surrogate keeps mail of one host together
        name = re.sub(r"[^a-z0-9]", "", low)
        tag = hashlib.sha256(self.permute.key + low.encode()).hexdigest()[:16]
        return f"{new}@{self._shape('host', name[:8])}-{tag}.{RESERVED}"

    def ip(self, value: str) -> str:
        x = 0
        for part in value.split("."):
            x = x * 256 + int(part)
        bits = self._reserved(x)
        if bits is None:
            x = self.permute.of("ip", x, 1 << 32)
            while self._reserved(x) is not None:
                x = self.permute.of("ip", x, 1 << 32)
        else:
            host = (1 << 32 - bits) - 1
            x = x & ~host | self.permute.of(f"ip{bits}:{x >> 32 - bits}", x & host, host + 1)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    @staticmethod
    def _reserved(x: int) -> int | None:
        """Bits of the reserved network (private, loopback, link-local, for documents, multicast and beyond) that an address is in; None for a public one."""
        return next((bits for net, bits in RESERVED_NETS if x >> 32 - bits == net >> 32 - bits), None)

    def number(self, value: str) -> str:
        return self.card(value)

    def card(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        new = self._shape("card", digits[:-1], 1)
        # a valid number stays valid; another keeps its distance from the check digit
        off = (int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10
        new += str((int(luhn_digit(new)) + off) % 10)
        return self._laid(value, new)

    @staticmethod
    def _laid(value: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isalnum() else c for c in value)

    def iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        country, check, body = plain[:2], int(plain[2:4]), plain[4:]
        rest = self._shape("iban" + country, body)
        if 2 <= check <= 98:
            # check numbers run from 2 to 98: the distance from the valid one stays, so a valid number stays valid
            check = 2 + (int(iban_check(country, rest)) - 2 + check - int(iban_check(country, body))) % 97
        return self._laid(value, f"{country}{check:02d}{rest}")

    def ssn(self, value: str) -> str:
        def given_out(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = old = re.sub(r"\D", "", value)
        while True:
            digits = self._shape("ssn", digits)
            if given_out(digits) == given_out(old):
                return self._laid(value, digits)

    @staticmethod
    def _national(value: str) -> tuple[int, str]:
        """How many digits stand before the national number (country code and trunk zeros), and that number."""
        digits = re.sub(r"\D", "", value)
        country = re.match(r"\+(\d{1,3})[ .(-]", value)
        before = len(country[1]) if country else 1 if re.match(r"\+1\d{10}$", value) else 0
        while before < len(digits) - 1 and digits[before] == "0" and len(digits) - before > 10:
            before += 1
        return before, digits[before:]

    def phone(self, value: str) -> str:
        before, national = self._national(value)
        digits = re.sub(r"\D", "", value)
        new = national
        while True:
            new = self._shape("phone", new)
            if (new[0] == "0") == (national[0] == "0"):
                return self._laid(value, digits[:before] + new)

    def name(self, value: str) -> str:
        return "".join(p if p in PARTICLES or not p[0].isalpha() else self._word(p) for p in _PART.findall(value))

    def _word(self, word: str) -> str:
        """A listed given name becomes one of its list (gender and script); another word one of its script and length, which no listed name is."""
        title = word[:1].upper() + word[1:].lower()
        group = _OF_NAME.get(title)
        if group:
            names = GIVEN[group]
            new = names[self.permute.of(f"given{group}", names.index(title), len(names))]
            return new.upper() if word.isupper() else new
        # a letter whose lower case is two characters stays as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
        end = self._ending(low)
        stem = low[: len(low) - len(end)]
        while True:
            stem = self._letters(stem)
            new = stem + end
            if self._ending(new) == end and new[:1].upper() + new[1:] not in _OF_NAME:
                return "".join(a.upper() if b != b.lower() and len(a.upper()) == 1 else a for a, b in zip(new, word, strict=True))

    @staticmethod
    def _ending(low: str) -> str:
        """The longest ending that tells a gender, of a word that has three letters more."""
        return next((e for e in ENDINGS if len(low) >= len(e) + 3 and low.endswith(e)), "")

    def _letters(self, low: str) -> str:
        """A pronounceable word: vowels are permuted among vowels, consonants among consonants, Han characters among these."""
        x, size, used = 0, 1, []
        for c in low:
            chars = LETTERS[_CLASS[c]] if c in _CLASS else None
            if chars:
                x, size = x * len(chars) + chars.index(c), size * len(chars)
            elif HAN[0] <= ord(c) <= HAN[1]:
                chars = HAN
                x, size = x * (HAN[1] - HAN[0] + 1) + ord(c) - HAN[0], size * (HAN[1] - HAN[0] + 1)
            used.append(chars)
        shape = "".join(c if u is None else "*" if u is HAN else str(LETTERS.index(u)) for c, u in zip(low, used, strict=True))
        x = self.permute.of(f"word:{shape}", x, size)
        out = list(low)
        for i in reversed(range(len(low))):
            if used[i] is HAN:
                x, d = divmod(x, HAN[1] - HAN[0] + 1)
                out[i] = chr(HAN[0] + d)
            elif used[i]:
                x, d = divmod(x, len(used[i]))
                out[i] = used[i][d]
        return "".join(out)


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, int, int]]]:
    """The text with surrogates, and each entity's kind, begin and end (code points) in the new text, and keyed numbers of the entity and its surrogate."""
    named = not _NAME_TOKENS.isdisjoint(map(str.lower, _TOKEN.findall(text))) or bool(_MORE.search(text)) or bool(_PATRONYM.search(text))
    if not (named or "@" in text or _HINT.search(text)):
        return text, []
    german = named and len(_GERMAN.findall(text)) * 60 > len(text) ** 0.5 * 8
    out, spans, at, length = [], [], 0, 0
    for m in (WITH_NAMES if named else ENTITY).finditer(text):
        kind = m.lastgroup
        lo, hi = m.span(kind)
        if kind == "run":
            begin = name_at(text, lo, hi, german)
            if begin is None:
                continue
            lo += begin
        if kind == "initials" and m[kind][0] == m[kind].replace(" ", "")[2:3] and _ENDED.search(text, max(0, lo - 3), lo):
            continue  # sentences of one letter
        if kind in ("titled", "cued", "initials", "run", "han", "hantitled", "hancalled", "arabic"):
            kind = "name"
        elif kind == "card" and not is_card(m["card"]):
            kind = "number"
        new, before, after = surrogates.of(kind, text[lo:hi])
        out += [text[at:lo], new]
        length += lo - at
        spans.append((kind, length, length + len(new), surrogates.digest(kind, before), surrogates.digest(kind, after)))
        length += len(new)
        at = hi
    return "".join([*out, text[at:]]), spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_IDS = pa.list_(pa.struct([("entity", pa.int64()), ("surrogate", pa.int64())]))
_NEW = "entities array<struct<kind:string,start:bigint,end:bigint>>, entity_ids array<struct<entity:bigint,surrogate:bigint>>"


def _replaced(key: bytes, column: str):
    def run(batches):
        surrogates = Surrogates(key)
        for batch in batches:
            i = batch.schema.get_field_index(column)
            texts, spans, ids = [], [], []
            for t in batch.column(i).to_pylist():
                new, found = replace(t, surrogates) if t else (t, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b, _, _ in found])
                ids.append([{"entity": e, "surrogate": s} for _, _, _, e, s in found])
            columns = batch.columns
            columns[i] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(spans, _SPANS), pa.array(ids, _IDS)], [*batch.schema.names, "entities", "entity_ids"])

    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """Replace personal data in docs' texts; adds entities (kind, start, end in the new text) and entity_ids (keyed numbers of each entity and its surrogate).

    Surrogates come from the key and the entity alone, so that one entity has the same one in every document (and when
    run again), with nothing to gather or join. Permutations without fixed points keep entities distinct and change
    each; `collisions` checks that on the result. Null texts stay null and empty ones empty, without entities; long
    texts are read whole; repeated rows, equal and null ids give a row each, no rows none. Columns named entities and
    entity_ids are replaced. Digits in a card's form whose check digit doesn't hold are replaced as numbers.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("entities", "entity_ids")
    return docs.mapInArrow(task(_replaced(key, text_col)), T.StructType([*docs.schema, *T.StructType.fromDDL(_NEW)]))


def collisions(replaced: DataFrame) -> DataFrame:
    """The check of a result of pseudonymise: surrogates that stand for several entities, and entities with several surrogates; it must have no rows."""
    pairs = replaced.select(F.explode(F.arrays_zip("entities", "entity_ids")).alias("x")).select(F.col("x.entities.kind").alias("kind"), "x.entity_ids.*").distinct()
    sides = [pairs.groupBy("kind", F.col(a).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("side", F.lit(a)) for a in ("surrogate", "entity")]
    return sides[0].unionByName(sides[1])


def checked(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """pseudonymise, written and checked: an error if two entities of the whole table share a surrogate, or one has two."""
    out = Scratch(docs.sparkSession, "pii").table(pseudonymise(docs, key, text_col), "replaced")
    wrong = collisions(out).count()
    if wrong:
        raise ValueError(f"{wrong} surrogates aren't one to one; use another key")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    out = checked(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("entities", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, "entities", "text")
