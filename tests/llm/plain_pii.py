"""A plain version of the pseudonyms, with numbers and strings of Python, to compare the expressions with."""

import datetime
import hashlib
import hmac

import regex as re

from skein.llm import pii

FOUND = re.compile(pii.FOUND)
SHAPES = [(name, re.compile("(?:" + p + r")\Z")) for name, p in pii.KINDS]


def keyed(key, *parts):
    return int(hmac.new(key.encode(), "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:13], 16)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10


def digits(d, key, tag):
    n = len(d)
    if n < 2:
        return d and str((int(d) + keyed(key, tag)) % 10)
    half = n // 2
    a, b = int(d[:half]), int(d[half:])
    for r in range(8):
        if r % 2:
            a = (a + keyed(key, tag, n, r, b)) % 10**half
        else:
            b = (b + keyed(key, tag, n, r, a)) % 10 ** (n - half)
    return f"{a:0{half}d}{b:0{n - half}d}"


def below(v, size, key, tag, inside=lambda v: True):
    side = int(size**0.5) + 1
    while True:
        a, b = divmod(v, side)
        for r in range(8):
            if r % 2:
                a = (a + keyed(key, tag, r, b)) % side
            else:
                b = (b + keyed(key, tag, r, a)) % side
        v = a * side + b
        if v < size and inside(v):
            return v


def refill(shape, fresh, kind):
    it = iter(fresh)
    return "".join(next(it) if re.match(kind, c) else c for c in shape)


def spelling(text, key, tag, alphabets=pii.ALPHABETS):
    def passed(text, side):
        out = ""
        for c in text:
            m = keyed(key, tag, side, len(out), out)
            alphabet = next((a for a in alphabets if c in a), None)
            out += alphabet[(alphabet.index(c) + m) % len(alphabet)] if alphabet else c
        return out

    return passed(passed(text, "forward")[::-1], "backward")[::-1]


def date(v, key):
    sep = re.search("[-/.]", v)[0]
    p = v.split(sep)
    iso = len(p[0]) == 4
    month_first = not iso and int(p[1]) > 12
    y, m, d = p if iso else (p[2], p[0], p[1]) if month_first else (p[2], p[1], p[0])
    try:
        number = (datetime.date(int(y), int(m), int(d)) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return v

    def spelt(day):
        m2 = str(day.month) if len(m) == 1 else f"{day.month:02d}"
        d2 = str(day.day) if len(d) == 1 else f"{day.day:02d}"
        return sep.join([str(day.year), m2, d2] if iso else [m2, d2, str(day.year)] if month_first else [d2, m2, str(day.year)])

    def alike(n):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(n)
        if len(spelt(day)) != len(v):
            return False
        return all(len(a) == len(b) for a, b in zip(spelt(day).split(sep), p)) and (not month_first or day.day > 12)

    return spelt(datetime.date(1900, 1, 1) + datetime.timedelta(below(number, 73049, key, "date", alike)))


def card(v, key):
    d = re.sub("[^0-9]", "", v)

    def permuted(d):
        body = digits(d[:-1], key, "card")
        return next(body + c for c in "0123456789" if luhn(body + c) == 0)

    if luhn(d) == 0:
        return refill(v, permuted(d), "[0-9]")
    if re.match(r"(?:[0-9]{4}[ -]){4}[0-9]{3}\Z", v) and luhn(d[:16]) == 0:
        return refill(v, permuted(d[:16]) + d[16:], "[0-9]")
    return v


def iban(v, key):
    flat = v.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if number(flat[4:] + flat[:4]) % 97 != 1:
        return v
    body = refill(flat[4:], digits(re.sub("[^0-9]", "", flat[4:]), key, "iban"), "[0-9]")
    return refill(v, flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body, "[A-Z0-9]")


def pseudonym(v, key):
    kind = next((name for name, p in SHAPES if p.match(v)), None)
    if kind == "email":
        local, domain = v.split("@")
        label, rest = domain.split(".", 1)
        return spelling(local, key, "local") + "@" + spelling(label, key, "domain") + "." + rest
    if kind == "secret":
        head = re.match(r"(?:[A-Za-z_-]+[ \t]*[:=][ \t]*[\"']?|AKIA|ASIA)", v)[0]
        return head + spelling(v[len(head) :], key, "secret")
    if kind == "ip":
        n = below(int.from_bytes(bytes(map(int, v.split("."))), "big"), 2**32, key, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ipv6":
        return spelling(v, key, "ipv6", ("0123456789ABCDEF",) if re.search("[A-F]", v) else ("0123456789abcdef",))
    if kind == "phone":
        head = (re.match(pii.CALLING_CODE, v) or [""])[0]
        return head + refill(v[len(head) :], digits(re.sub("[^0-9]", "", v[len(head) :]), key, "phone"), "[0-9]")
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        n = below(((a - 2 if a > 666 else a - 1) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
        a = n // (99 * 9999) + 1
        return f"{a + (a >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    return {"date": date, "card": card, "iban": iban}[kind](v, key) if kind else v


def pseudonymise(text, key):
    return text if text is None else FOUND.sub(lambda m: pseudonym(m[0], key), text)
