"""Labelled spans to train the tagger of ``personal``: made-up personal data and look-alikes, set in pieces of real text."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Where a session has no text to set the data in.
CARRIERS = (
    "Please send the signed form back to the office before the end of the week, or ask at the desk for a new one. ",
    "Bitte rufen Sie uns an, wenn Sie am Montag nicht kommen können, damit wir den Termin verschieben. ",
    "Merci de répondre avant la fin du mois et de joindre une copie de la facture à votre lettre. ",
    "Si tiene alguna duda sobre el pedido, escriba a nuestra oficina o pase por la tienda por la tarde. ",
)
LEADS = {
    "email": ("", "", "mail: ", "e-mail ", "contact ", "write to ", "Schreiben Sie an ", "écrire à ", "correo: ", "reach me: ", "("),
    "ip": ("", "", "host ", "server ", "from ", "IP: ", "address ", "login from ", "Adresse ", "["),
    "card": ("", "", "card ", "card number: ", "Visa ", "paid with ", "Kartennummer ", "carte ", "tarjeta ", "cc: "),
    "phone": ("", "tel ", "Tel.: ", "phone: ", "call ", "call me at ", "fax ", "Telefon ", "tél. ", "teléfono ", "mobile ", "whatsapp "),
}
FIRST = ("anna", "ben", "carla", "david", "eva", "felix", "greta", "hugo", "ines", "jörg", "karl", "lena", "mario", "nora", "olga", "paul", "rené", "sara", "tom", "zoé")
LAST = ("adler", "brown", "costa", "diaz", "evans", "fischer", "garcia", "huber", "jones", "keller", "lopez", "martin", "novak", "olsen", "petit", "rossi", "smith", "weber")
HOSTS = ("example", "mail", "post", "webmail", "acme", "uni-lab", "office", "firma", "tienda", "bureau", "mail7", "inbox")
ENDS = ("com", "org", "net", "de", "fr", "es", "info", "co.uk", "example.com", "edu", "io")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


class Maker:
    """Draws values from one seeded generator."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.one(first) + "".join(map(str, self.rng.integers(0, 10, n - 1)))

    def email(self) -> str:
        name = self.one((self.one(FIRST), f"{self.one(FIRST)}.{self.one(LAST)}", f"{self.one(FIRST)[0]}_{self.one(LAST)}", f"{self.one(FIRST)}{self.digits(2)}", f"{self.one(LAST)}-{self.one(FIRST)}"))
        at, dot = self.one((("@", "."), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("[@]", "."), (" arroba ", " punto "), (" arobase ", " point "), ("@", " punkt "), ("{at}", "{dot}"), ("@", "[.]")))
        host = f"{self.one(HOSTS)}.{self.one(ENDS)}"
        return name.replace(".", dot if dot.strip() != dot and self.rng.random() < 0.7 else ".") + at + host.replace(".", dot)

    def ip(self) -> str:
        if self.rng.random() < 0.25:
            parts = [f"{int(x):x}" for x in self.rng.integers(0, 65536, 8)]
            return self.one((":".join(parts), f"2001:db8::{parts[0]}:{parts[1]}", f"fe80::{parts[0]}:{parts[1]}:{parts[2]}:{parts[3]}", f"2001:db8:{parts[0]}::{parts[1]}"))
        a, b, c, d = (str(int(x)) for x in self.rng.integers(0, 256, 4))
        dot = self.one(("[.]", "(.)", " . ", "[dot]", " dot ", "{.}", "."))
        return self.one((f"{a}{dot}{b}{dot}{c}{dot}{d}", f"{a}.{b}.{c}[.]{d}" if dot != "." else f"{a}.{b}.{c}.{d}"))

    def card(self) -> str:
        n = self.one((13, 15, 16, 16, 16, 16, 19))
        body = self.digits(n - 1, "3456")
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = self.one((".", "/", "_", "  ", " - ", " ", "-", "", "\u00a0", " / "))
        size = 4
        return gap.join(body[i : i + size] for i in range(0, n, size))

    def phone(self) -> str:
        a, b, c = self.digits(3, "23456789"), self.digits(3), self.digits(4)
        pairs = [self.digits(2) for _ in range(4)]
        return self.one((
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"0{self.one('123456789')} {' '.join(pairs)}", f"0{self.one('123456789')}.{'.'.join(pairs)}",
            f"0{a} {self.digits(7)}", f"0{a}/{self.digits(6)}", f"00{self.one(('1', '33', '44', '49', '34'))} {a} {b} {c}", f"+{self.one(('1', '33', '44', '49', '34'))}/{a}/{b}{c}", f"9{self.digits(2)} {b} {self.digits(3)}",
            f"+1 ({a}) {b}-{c}",
        ))

    def other(self) -> str:
        """What looks like personal data and is none."""
        n, r = self.digits, self.rng
        day, month, year = int(r.integers(1, 29)), int(r.integers(1, 13)), int(r.integers(1950, 2031))
        bad = n(16, "123456789")
        while luhn(bad):
            bad = n(16, "123456789")
        return self.one((
            f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{year}-{month:02}-{day:02}T{day:02}:{month:02}:{n(2, '012345')}Z", f"{day:02}:{n(2, '012345')}:{n(2, '012345')}",
            f"${n(1)},{n(3)},{n(3)}.{n(2)}", f"{n(3)}.{n(3)}.{n(3)},{n(2)} EUR", f"{n(1)}.{n(6)}, -{n(2)}.{n(6)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"v{n(1)}.{n(2)}.{n(1)}", f"pages {n(3)}-{n(3)}", f"{year}-{year + 4}",
            bad, f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", "".join(f"{int(x):x}" for x in r.integers(0, 16, 40)), f"order {n(9)}", f"no. {n(7)}", f"id={n(12)}", f"{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}, {n(2)}", f"{n(8)}-{n(4)}-{n(4)}",
            f"{n(1)}:{n(2)}:{n(2)}::{self.one(FIRST)}", f"@{self.one(FIRST)}", f"{self.one(FIRST)} at noon. {self.one(LAST)}.", f"look at the dot on page {n(2)}", f"at {self.one(HOSTS)}.{self.one(ENDS)}", f"{n(1)} + {n(3)} - {n(4)} = {n(4)}", f"{n(3)}x{n(3)}x{n(2)}", f"+{n(2)} %", f"@media (min-width: {n(4)}px)", f"{n(4)}, {n(4)}, {n(4)} and {n(4)}",
            f"{n(3, '3456789')}.{n(3, '3456789')}.{n(3, '3456789')}.{n(3, '3456789')}", f"{year} {year + 1} {year + 2} {year + 3}", f"token = \"{''.join(f'{int(x):x}' for x in r.integers(0, 16, 40))}\"",
        ))


def labelled(texts: list[str], number: int, size: int, seed: int, base=lambda text: []) -> tuple[list[str], np.ndarray]:
    """(windows of ``size`` characters, labels): each with personal data, a look-alike or nothing set into a piece of one of ``texts``.

    Labels are 0 outside, 2k + 1 at the first character of a span of kind k and 2k + 2 within it.  ``base`` gives the
    spans (kind, start, end) of a text that are known without a model; those of the piece itself are labelled too.
    """
    maker, rng = Maker(seed), np.random.default_rng(seed + 1)
    carriers = [t for t in texts if t.strip()] or list(CARRIERS)
    windows, labels = [], np.zeros((number, size), np.int64)
    for row in range(number):
        whole = maker.one(carriers) if rng.random() < 0.8 else maker.one(CARRIERS)
        whole = whole * (1 + 2 * size // len(whole))
        at = int(rng.integers(0, len(whole) - size + 1))
        piece = whole[at : at + size]
        kind = int(rng.integers(0, 7))
        value = getattr(maker, KINDS[kind])() if kind < 4 else maker.other() if kind < 6 else ""
        lead = maker.one(LEADS[KINDS[kind]]) if kind < 4 else maker.one(LEADS[maker.one(KINDS)]) if rng.random() < 0.3 else ""
        bare = value.isdigit() and kind == 3
        lead = maker.one(LEADS["phone"][1:]) if bare else lead
        put = int(rng.integers(0, max(1, size - len(lead) - len(value))))
        left = piece[:put]
        if left and left[-1].isalnum():
            left = left[:-1] + maker.one((" ", " ", " ", "\n", ":", "\"", "("))
        tail = maker.one((" ", " ", ", ", ". ", "\n", ")", "; ", ".")) if value else ""
        text = left + lead + value + tail
        start = len(left + lead)
        text = (text + piece[put:])[:size].ljust(size)
        # the value may be cut by the window's end, as it may be in a text
        if kind < 4:
            end = min(size, start + len(value))
            labels[row, start:end] = 2 * kind + 2
            if start < size:
                labels[row, start] = 2 * kind + 1
        shift = int(rng.integers(0, size // 2)) if rng.random() < 0.3 else 0
        for name, a, b in base(text):
            if not labels[row, a:b].any():
                labels[row, a:b] = 2 * KINDS.index(name) + 2
                labels[row, a] -= 1
        if shift:  # a window that begins within or after the value
            text = text[shift:] + whole[:shift]
            labels[row] = np.concatenate([labels[row, shift:], np.zeros(shift, np.int64)])
        windows.append(text)
    return windows, labels
