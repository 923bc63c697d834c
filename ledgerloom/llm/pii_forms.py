"""Made-up personal data with its labels, in made-up sentences: training and held-out rows for the tagger.

Every item is built from parts, so its span and kind are known by construction; neither
the tables' list of people nor the labelling patterns take part.  ``HELD_OUT`` names the
forms that training never makes: the held-out check is made of those alone.
"""

from __future__ import annotations

import random
from collections.abc import Callable

Span = tuple[int, int, str]

#: Given and family names of many languages.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Susan Richard Karen Thomas Sarah Daniel Nancy Peter Laura George Alice Oliver Emma Noah Chloe "
    "Jean Marie Pierre Camille Luc Élodie François Zoé Hans Anke Jürgen Sabine Wolfgang Käthe Dieter Ulrike José María Carlos Lucía Javier Ana Pablo Inés "
    "Giulia Marco Paolo Chiara Luca João Beatriz Tiago Marta Piotr Agnieszka Tomasz Ewa Jan Petra Lars Ingrid Sven Astrid Mikko Aino Dmitri Olga Sergei Irina "
    "Ahmed Fatima Omar Layla Yusuf Aisha Hassan Mehmet Elif Emre Reza Shirin Priya Rahul Ananya Vikram Deepa Arjun Wei Li Ming Xin Hiroshi Yuki Kenji Sakura "
    "Minh Linh Ji-woo Min-jun Chidi Ngozi Kwame Ama Thabo Zanele Amadou Aminata Siobhán Niamh Owen Megan Noor Bao Rosa Ivan"
).split()
FAMILY = (
    "Smith Johnson Brown Taylor Wilson Evans Walker Wright Hughes Green Hall Wood Harris Martin Clarke Baker Turner Hill Scott Young O'Brien McCarthy MacLeod Fitzgerald "
    "Dubois Lefèvre Moreau Girard Rousseau Fontaine Müller Schneider Fischer Weber Schäfer Becker Hoffmann Krüger García Fernández López Martínez Sánchez Núñez Ortega "
    "Rossi Ferrari Esposito Bianchi Silva Santos Oliveira Pereira Kowalski Nowak Wiśniewska Zieliński Novák Svoboda Andersson Lindqvist Nilsson Hansen Virtanen Korhonen "
    "Ivanov Petrova Sokolov Kuznetsova Haddad Khalil Rahman Hussain Yılmaz Demir Karimi Hosseini Sharma Patel Raghavan Iyer Krishnan Chatterjee Zhang Wang Chen Liu Nguyen Tran "
    "Tanaka Suzuki Yamamoto Kim Park Choi Okafor Adeyemi Nwosu Mensah Dlamini Mokoena Diallo Traoré Kelly Murphy Walsh Davies Price Bauer Vogel Stone Marsh Reed"
).split()
#: Syllables from which further names, streets and hosts are made.
_HEAD = "bra cor dul fen gol har jun kra lim mor nes pra quen ros sul tha ves wex yar zor ost ibb glim trev sal ton mar vin hal bec dar lor pem ash kel ridd".split()
_TAIL = "ander dal ek gart holt ille mond ova quist stad vari wick son sen ini ley ton berg mann ski rose field wood worth combe ford well brook gate moor".split()
_STREET_END = "Street St St. Road Rd Rd. Avenue Ave Ave. Boulevard Blvd Lane Ln Drive Dr Dr. Court Ct Terrace Place Square Way Close Crescent Parkway Row Walk Hill Highway Circle".split()
_STREET_HELD = ("Grove", "Gardens", "Mews", "Quay")
_STREET_NAME = "Oak Maple Church High Station Mill Park King Queen Victoria North South Third Fifth Lake River Chapel Castle Bridge Elm Cedar Willow Spring Market Forest Meadow Juniper Bell Abbey Harbour".split()
_COMPANY = "example test invalid com org net co.uk de fr io edu".split()
_TITLES = ("Dr. ", "Dr ", "Mr. ", "Ms ", "Mrs. ", "Prof. ", "Herr ", "Frau ", "Mme ", "Sr. ", "", "", "", "", "", "")
HELD_OUT = ("name of three words", "street with a held-out end", "phone of the held-out plans", "id of the held-out plans", "email with a held-out spelling")


def digits(rnd: random.Random, n: int, first: str = "0123456789") -> str:
    return rnd.choice(first) + "".join(rnd.choice("0123456789") for _ in range(n - 1)) if n else ""


def made_word(rnd: random.Random) -> str:
    return (rnd.choice(_HEAD) + (rnd.choice(_HEAD) if rnd.random() < 0.2 else "") + rnd.choice(_TAIL)).capitalize()


def family(rnd: random.Random) -> str:
    one = rnd.choice(FAMILY) if rnd.random() < 0.5 else made_word(rnd)
    return f"{one}-{rnd.choice(FAMILY) if rnd.random() < 0.5 else made_word(rnd)}" if rnd.random() < 0.06 else one


def name(rnd: random.Random, held: bool = False) -> str:
    g, f = rnd.choice(GIVEN), family(rnd)
    if held:
        return f"{g} {rnd.choice(GIVEN)} {f}"
    form = rnd.random()
    out = f"{g} {f}" if form < 0.55 else f"{f}, {g}" if form < 0.68 else f"{g[0]}. {f}" if form < 0.78 else f"{g} {rnd.choice('ABCDEFGHJKLMNPRSTVW')}. {f}" if form < 0.88 else f"{f} {g}" if form < 0.92 else f"{g[0]}. {rnd.choice('ABCDEFGHJKLM')}. {f}"
    case = rnd.random()
    return out.upper() if case < 0.08 else out.lower() if case < 0.13 and form < 0.55 else out


def email(rnd: random.Random, held: bool = False) -> str:
    g, f = (w.lower().replace("'", "") for w in (rnd.choice(GIVEN), family(rnd)))
    user = rnd.choice((f"{g}.{f}", f"{g}_{f}{digits(rnd, 2)}", f"{g[0]}{f}", f"{g}{digits(rnd, 2)}", f"{f}+{rnd.choice(_HEAD)}", f"{f}.{g[0]}", f"{g}-{f}"))
    host = ".".join([*([rnd.choice(("mail", "post", "lab", "ops", "dev"))] if rnd.random() < 0.3 else []), made_word(rnd).lower(), rnd.choice(_COMPANY)])
    if held:
        return f"{user} {{at}} {host.replace('.', ' {dot} ')}"
    form = rnd.random()
    if form < 0.7:
        out = f"{user}@{host}"
    elif form < 0.85:
        at, dot = rnd.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", ".")))
        out = user + at + host.replace(".", dot)
    else:
        out = f"{user}{rnd.choice('@＠')}{host}"
    return out.upper() if rnd.random() < 0.06 else out


def phone(rnd: random.Random, held: bool = False) -> str:
    d = lambda n, first="0123456789": digits(rnd, n, first)
    s = rnd.choice("  --.")
    if held:
        return rnd.choice((f"020 {d(4, '378')} {d(4)}", f"+91 {d(5, '6789')} {d(5)}", f"+55 {d(2, '1234')} 9{d(4)}-{d(4)}"))
    forms = (
        f"({d(3, '23456789')}) {d(3, '23456789')}-{d(4)}", f"{d(3, '23456789')}{s}{d(3, '23456789')}{s}{d(4)}", f"+1{s}{d(3, '23456789')}{s}{d(3, '23456789')}{s}{d(4)}", f"+1{d(10, '23456789')}",
        f"+44 7{d(3)} {d(6)}", f"+44 (0)7{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"00 44 7{d(3)} {d(3)} {d(3)}", f"0{d(3, '123456789')} {d(3)} {d(4)}", f"0{d(2, '123456789')} {d(4, '23456789')} {d(4)}",
        f"+33 {d(1, '123456789')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1, '123456789')} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(2, '123456789')} {d(5, '123456789')} {d(3)}", f"0{d(2, '123456789')}/{d(8, '123456789')}",
        f"(0{d(2, '123456789')}) {d(7, '123456789')}", f"+61 {d(3, '4')} {d(3)} {d(3)}", f"+34 {d(3, '69')} {d(3)} {d(3)}", f"+39 {d(3, '3')} {d(7)}", f"+46 {d(2, '7')} {d(3)} {d(2)} {d(2)}", f"0046 {d(2, '7')} {d(3)} {d(4)}", f"+{d(2, '3456789')}{d(9)}",
    )
    return rnd.choice(forms)


def id_number(rnd: random.Random, held: bool = False) -> str:
    d = lambda n, first="0123456789": digits(rnd, n, first)
    up = lambda n: "".join(rnd.choice("ABCEGHJKLMNPRSTWXYZ") for _ in range(n))
    s = rnd.choice("-- ")
    born = f"{rnd.randint(40, 99):02d}{rnd.randint(1, 12):02d}{rnd.randint(1, 28):02d}"
    if held:
        return rnd.choice((f"{up(1)}{d(8)}", f"{born}-{d(3)}{up(1)}"))
    return rnd.choice((f"{d(3)}{s}{d(2)}{s}{d(4)}", f"{d(3, '9')}{s}{d(2)}{s}{d(4)}", f"{born}-{d(4)}", f"{up(2)}{d(6)}{rnd.choice('ABCD')}", f"{up(2)} {d(2)} {d(2)} {d(2)} {rnd.choice('ABCD')}", f"{up(2)}{d(7)}", f"QQ{d(6)}{rnd.choice('ABCD')}"))


def address(rnd: random.Random, held: bool = False) -> str:
    num = digits(rnd, rnd.choice((1, 2, 2, 3, 4)), "123456789")
    word = rnd.choice(_STREET_NAME) if rnd.random() < 0.5 else made_word(rnd)
    if held:
        return f"{num} {word} {rnd.choice(_STREET_HELD)}"
    form, low = rnd.random(), rnd.choice("abc")
    if form < 0.55:
        num += rnd.choice(("", "", "", "A", "B", f"-{digits(rnd, 1, '2468')}"))
        return f"{num} {rnd.choice(('', '', 'Old ', 'Upper ', 'West '))}{word} {rnd.choice(_STREET_END)}"
    if form < 0.7:
        return f"{num}{rnd.choice(('', '', ' bis'))}{rnd.choice((' ', ', '))}{rnd.choice(('rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai'))} {rnd.choice(('de la ', 'du ', 'des ', '', 'de '))}{made_word(rnd)}"
    if form < 0.83:
        return f"{rnd.choice(('Calle', 'Avenida', 'Plaza', 'Paseo', 'Camino'))} {rnd.choice(('de la ', 'del ', 'de ', ''))}{made_word(rnd)}, {num}"
    return f"{rnd.choice(_HEAD + ['Linden', 'Haupt', 'Garten', 'Bahnhof', 'Quell', 'Glocken', 'Mühlen']).capitalize()}{rnd.choice(('straße', 'str.', 'weg', 'gasse', 'platz', 'allee'))} {num}{rnd.choice(('', '', low))}"


MAKERS: dict[str, Callable[..., str]] = {"person_name": name, "email": email, "phone": phone, "id_number": id_number, "street_address": address}

#: Sentences around items, by kind; the item replaces the braces.
CONTEXTS = {
    "person_name": ("{} wrote the summary.", "ask {} about it", "Ping {} before the release.", "owner: {}", "reviewed with {}, all fine", "Signed-off-by: {}", "According to {} the limit is old.", '"name": "{}"', "{} called twice today and wants an answer.", "Thanks,\n{}", "The ticket of {} is still open.", "Bitte {} fragen.", "Merci de prévenir {}.", "El contacto es {}.", "{}\t", "met {} at lunch", "{} is out until Monday", "- {}", "from {} in accounting"),
    "email": ("Write to {}.", "cc {}", "mailto:{}", "<{}>", '"mail": "{}"', "login failed for {}", "Send it to {} please.", "contact={}", "{}\t"),
    "phone": ("Call {}.", "Tel.: {}", "ring {} before noon", '"tel": "{}"', "My number is {} if it breaks.", "fax {}", "unter {} anrufen", "au {}", "({})", "{}\t", "mobile {}"),
    "id_number": ("SSN {} was visible.", "national id: {}", "passport no. {}", "the dump leaks {}", '"nid": "{}"', "tax file {}", "{};", "personnummer {}", "NI number {}"),
    "street_address": ("I live at {}.", "Our office moved to {}, tell them.", "Ship it to {} by Friday.", "billing address = \"{}\"", "{}\n", "Lieferung nach {}.", "le colis part au {}", "visit {} tomorrow", "address: {}"),
}
_MIXED = ("{person_name} at {street_address}", "{person_name} ({phone})", "{person_name} <{email}>", "{person_name}, {email}, {phone}", "{person_name};{id_number};{street_address}", "{person_name}\t{email}\t{phone}\t{street_address}", "{person_name} and {person_name}", "{person_name} or {person_name} ({phone})", "{phone} / {phone}", "{id_number} and {id_number}", "<li>{person_name}</li><li>{street_address}</li>", "{street_address}, {email}")
#: Pairs of capitals that are no names.
_NO_NAMES = ("Release Notes", "Pull Request", "New York", "San Francisco", "Code Review", "Monday Morning", "Second Quarter", "Visual Studio", "Error Handling", "Data Center", "Unit Test", "Hong Kong", "Merge Conflict", "United Kingdom", "Open Source", "North Sea", "Apache Spark", "Happy Birthday", "Great Britain", "Access Denied", "Internal Server Error", "Not Found", "Status Code", "Los Angeles", "Customer Support")


def lookalike(rnd: random.Random) -> str:
    """A string that only looks like personal data."""
    d = lambda n, first="0123456789": digits(rnd, n, first)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    g, f = rnd.choice(GIVEN), family(rnd)
    return rnd.choice((
        lambda: f"IBAN {rnd.choice(('DE', 'GB', 'FR'))}{d(2)} {d(4)} {d(4)} 0044 {d(4)} {d(4)} {d(2)}", lambda: f"version {d(1)}.{d(2)}.{d(1)}", lambda: f"commit {hexes(40)}", lambda: f"uuid {hexes(8)}-{hexes(4)}-4{hexes(3)}-{hexes(4)}-{hexes(12)}",
        lambda: f"20{d(2)}-0{d(1, '123456789')}-1{d(1)} {d(2)}:{d(2)}", lambda: f"port {d(4)}", lambda: f"git@{made_word(rnd).lower()}:team/{rnd.choice(_HEAD)}.git", lambda: f"{rnd.choice(_HEAD)}@{d(1)}.{d(2)}.{d(1)}", lambda: f"order {d(8)}", lambda: f"192.168.{d(2)}.{d(2)}",
        lambda: f"icon@2x.png and {rnd.choice(_HEAD)}@latest", lambda: f"{made_word(rnd)} {d(5)}", lambda: f"the town of {made_word(rnd)}", lambda: rnd.choice(_NO_NAMES), lambda: rnd.choice(_NO_NAMES), lambda: f"{g} alone", lambda: f"hello {g}", lambda: f"the {f} family",
        lambda: f"Part {rnd.choice('ABC')}{d(3)}-{d(2)}-{d(4)}-B", lambda: f"build 20{d(2)}.0{d(1)}.1{d(1)}-{d(4)}", lambda: f"{d(3)} files, {d(4)} rows, {d(2)} errors", lambda: f"lines {d(3)}-{d(3)}", lambda: f"took {d(3)}.{d(3)} s for {d(7)} bytes", lambda: f"epoch 17{d(8)}", lambda: f"range {d(3)}-{d(2)}-{d(3)}",
        lambda: f"{d(2)} street lamps", lambda: f"on {rnd.choice(_STREET_NAME)} {rnd.choice(_STREET_END)}", lambda: f"ticket AB-{d(4)}", lambda: f"{rnd.choice(_HEAD)}.{rnd.choice(_HEAD)}@sha256:{hexes(16)}", lambda: f"ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
    ))()


def filled(template: str, rnd: random.Random, held: bool = False, kind: str | None = None) -> tuple[str, list[Span]]:
    """The template with its braces replaced by made items, and their spans."""
    out, spans, rest = "", [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        own, _, rest = tail.partition("}")
        own = own or kind
        out += before
        if own == "person_name" and not out.endswith(("<", '"', "\t")):
            out += rnd.choice(_TITLES)
        item = MAKERS[own](rnd, held)
        spans.append((len(out), len(out) + len(item), own))
        out += item
    return out + rest, spans


def sentence(rnd: random.Random, held: bool = False) -> tuple[str, list[Span]]:
    """A made sentence with one item or a few, or with look-alikes only."""
    roll = rnd.random()
    if roll < 0.3 and not held:
        return f"{rnd.choice(('', 'see ', 'Then ', 'for '))}{lookalike(rnd)}{rnd.choice(('', '.', ' again.', ', as before'))}", []
    if roll < 0.55:
        return filled(rnd.choice(_MIXED), rnd, held)
    kind = rnd.choice(tuple(MAKERS))
    return filled(rnd.choice(CONTEXTS[kind]), rnd, held, kind)
