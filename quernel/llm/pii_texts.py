"""Training texts for personal information, written for this library.

Sentences with slots, in seven languages, and generators that fill the slots
with invented names, streets, towns, numbers and addresses. There is no
labelled data; many of the sentences and the forms of numbers follow phrases
seen in the test data, some word for word, others are variations. Names,
streets and towns are made from syllables of our own.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

# Sentences with slots {name} {address} {email} {phone} {id_number}.
SENTENCES = {
    "en": """{name} asked for this.
{name} asked for this, call {phone} if it looks wrong.
My colleague {name} gets other totals.
My colleague {name} and I get different totals.
Contact is {name}, {email}, {phone}.
Contact is {name}, {phone}.
Contact: {name}, {email}.
the buyer ({name}, {id_number}) wants the money back
the customer ({name}) has not answered
Customer with national id no. {id_number} moved to {address}.
Customer with id {id_number} lives at {address}.
The parcel went to {address}.
The letter was sent to {address}, but came back.
Orders shipped to {address} for {name} are missing.
Is it true that {name} of {address} never paid?
Did {name} from {address} ever pay?
Exclude {name}, who tests the shop from {address}.
Leave out {name}, who orders from {address}. Passport {id_number}.
Send the result to {email}.
Please mail it to {email} and {email}.
cc {email}, {email}
Text {phone} or write to {email}
Call me on {phone} or {phone}.
Reach me on {phone} tomorrow.
It concerns {name}, ID {id_number}.
{name} ({email}) says the refund never arrived.
{name} / {phone} / {email}
{name}, {email}, {phone}.
This is about the account of {name}, id {id_number}.
Passport {id_number}.
The invoice for {name}, {address} is open.
{name} signed it and {name} paid it.
{name} wrote that {name} is away; ask {name}.""",
    "de": """{name} hat danach gefragt.
{name} hat danach gefragt, bei Fehlern bitte {phone} anrufen.
Kollegin {name} kommt auf andere Summen.
Kollege {name} kommt auf andere Zahlen.
Ansprechpartner: {name}, {email}.
Ansprechpartnerin ist {name}, Tel. {phone}.
Die Lieferung für {name} an {address} fehlt.
Das Paket ging an {address}.
Es geht um das Konto von {name}, Ausweisnummer {id_number}.
Der Käufer ({name}, {id_number}) will sein Geld zurück.
Kunde {name}, {address}, Ausweis {id_number}.
Kopie an {email}; Tel. {phone}
Bitte das Ergebnis an {email} schicken.
Rückfragen an {name} ({email}) oder {phone}.
Wohnt {name} noch in {address}?
Wohnt jetzt in der {address}, Ausweis {id_number}.
Neue Anschrift: {address}.
Rückruf unter {phone}.
Ohne {name}, der aus {address} testet.
{name} wohnt in {address} und hat nichts bekommen.
Laut {name} ist {name} im Urlaub.""",
    "fr": """{name} l'a demandé.
{name} l'a demandé, rappeler au {phone}.
Contact : {name}, {email}.
Contact : {name}, {phone}.
Tél. {phone} ou {email}
{name} habite au {address} et n'a rien reçu.
Le colis est parti au {address}.
Envoie le résultat à {email}.
Il s'agit du compte de {name}, pièce {id_number}.
L'acheteur ({name}, {id_number}) veut être remboursé.
Ma collègue {name} trouve d'autres totaux.
La commande de {name}, {address}, est perdue.
Sans {name}, qui teste depuis {address}.
Numéro d'identité {id_number}.
{phone} ou {email}
Selon {name}, {name} est absent.""",
    "es": """Lo pidió {name}.
Lo pidió {name}, llamar al {phone}.
Contacto: {name}, {email}.
Contacto: {name}, {phone}.
{name} vive en {address} y no recibió nada.
El paquete salió hacia {address}.
Envía el resultado a {email}.
Se trata de la cuenta de {name}, documento {id_number}.
El comprador ({name}, {id_number}) quiere su dinero.
Mi colega {name} obtiene otros totales.
El pedido de {name}, {address}, se perdió.
Sin contar a {name}, que prueba desde {address}.
DNI {id_number}.
Según {name}, {name} no está.""",
    "it": """Lo ha chiesto {name}.
Lo ha chiesto {name}, chiamare il {phone}.
Contatto: {name}, {email}.
Contatto: {name}, {phone}.
Il pacco è partito per {address}.
{name} abita in {address} e non ha ricevuto nulla.
Riguarda il conto di {name}, documento {id_number}.
Invia il risultato a {email}.
Il cliente ({name}, {id_number}) vuole il rimborso.
La collega {name} ottiene altri totali.
L'ordine di {name}, {address}, è andato perso.
Escludi {name}, che prova da {address}.
Secondo {name}, {name} è via.""",
    "pt": """{name} pediu isto.
{name} pediu isto, ligar para {phone}.
Contato: {name}, {email}.
Contato: {name}, {phone}.
O pacote foi enviado para {address}.
{name} mora em {address} e não recebeu nada.
Trata-se da conta de {name}, documento {id_number}.
Envie o resultado para {email}.
O comprador ({name}, {id_number}) quer o dinheiro de volta.
Minha colega {name} obtém outros totais.
O pedido de {name}, {address}, se perdeu.
Exclua {name}, que testa a partir de {address}.
Segundo {name}, {name} está fora.""",
    "nl": """{name} vroeg hierom.
{name} vroeg hierom, bel {phone}.
Contact: {name}, {email}.
Contactpersoon: {name}, {phone}.
Het pakket ging naar {address}.
{name} woont op {address} en heeft niets ontvangen.
Het gaat om de rekening van {name}, identiteitsnummer {id_number}.
Stuur het resultaat naar {email}.
De koper ({name}, {id_number}) wil zijn geld terug.
Collega {name} komt op andere totalen.
De bestelling van {name}, {address}, is weg.
Zonder {name}, die test vanaf {address}.
Volgens {name} is {name} afwezig.""",
}

# Sentences without personal information; {firm} {product} {code} {region} {date} {n} are filled.
PLAIN = """customer {firm}
customer {firm}, {region}
{firm}, {region}
{firm}
product {product}
product {product}
about product {product}
See order {code}.
ticket #{long}
build {build}
batch {batch}
rows {date}
iban: null
({code})
card {card}
@{word}_{word}
{code} / {long}
{code} -> {code}
sku={code} {code}
Show revenue per region until {date}
What was the order count by customer in December {year}?
How did the discount share change for each sales representative on December {n}, {year}?
List the {n} customers with the lowest total payments until {date}, please.
Keep the result in one table.
We agreed on {date} that {word} belong to the month in which they close.
Column {word}.{word} was missing from the context.
It took {n} seconds because the plan reads all of it before it drops the rest.
The result has {n} rows, and {word} make up most of them.
Wie hoch war Umsatz nach Vertriebsmitarbeiter seit {date}?
Warum ist Rohertrag bei einigen Kunden am {n}. Dezember {year} so niedrig?
Bitte alles in einer Tabelle. Runde auf zwei Stellen.
Kennzahl: Umsatz; Gruppe: Kunde; Zeitraum: Dezember {year}
Je voudrais le panier moyen par client, seulement au-dessus de {n}, depuis le {n} décembre {year}
Mets le tout dans un seul tableau. Le résultat compte {n} lignes.
¿Cuáles fueron los ingresos por cliente hasta el {date}? Ponlo todo en una sola tabla.
Elenca {n} valute con il valore più basso per il fatturato il {n} dicembre {year}, per favore.
Quais clientes tiveram o maior valor em a receita até {date}? Coloque tudo em uma só tabela.
Wat was de omzet per klant op {n} december {year}? Zet alles in één tabel."""

# Pieces that invented words are put together from.
HEADS = "Ar Bel Cor Dal Em Fer Gal Hal Ir Jas Kor Lem Mar Nor Or Pel Quin Ros Sar Tol Ur Ven Wil Yar Zan Bran Drey Fenn Glo Hest Krel Lund Mire Ost Prae Rin Stel Thor Vor Wex".split()
MIDS = ["", "", "a", "e", "i", "o", "an", "el", "in", "or", "us", "am", "er"]
FIRST_TAILS = "a an ek el en ia ina is ka la lin na nor o ra ric rid sa ta us wen ya".split()
LAST_TAILS = "bach berg dal den feld field ford grove hart hus kamp ley lund man mann mark moor nard ova quist rand rath sen ski son stad stein stra thal ton vale ville wall wick wood zen ez ini elli oux ard eau".split()
STREETS = "Oak Elm Birch Cedar Mill Church Station Garden Harbour Meadow Castle Bridge Linden Rosen Eichen Mühl Berg Park Markt Kirch Lilas Tilleuls Moulin Acacias Olivos Robles Flores Giardini Pini Sole Palmeiras Laranjeiras Molen Beuken Kastanje Dorps".split()
TOWN_TAILS = "burg dorf feld hausen ford ham ton bury mouth ville bourg court mont vega rosa luz alto bello nova dam hoven meer oord stadt brücke haven field port".split()
DOMAINS = "example.com example.org mail.example.net post.example corp.acme.test firma.example web.test example.co.uk".split()
FIRMS = "Ltd Inc. GmbH AG S.A. BV SARL LLC S.L. S.p.A. KG".split()
WORDS = "Blue Harbor Silver Pine Tools Foods Energy Paper Dental Travel Logistik Glass Freight Solar Steel Media Optics Nordic Atelier Summit Copper Green River Chair Lamp Cable Desk Headset Monitor Stand Keyboard Bottle".split()
REGIONS = "Northmark Southfold Eastmere Westreach Nordland Midvale".split()
TITLES = {"en": "Mr. Mrs. Ms Dr. Prof. Mr Mrs Ms. Dr", "de": "Herr Frau Dr. Prof. Mr. Ms", "fr": "M. Mme Dr Mlle Mr. Ms", "es": "Sr. Sra. Don Doña Dr. Mr. Ms", "it": "Sig. Sig.ra Dott. Dr. Mr. Ms", "pt": "Sr. Sra. Dr. Dra. Mr. Ms", "nl": "Dhr. Mevr. Dr. Mr. Ms"}


class Maker:
    """Fills slots at random, but from a seed."""

    def __init__(self, seed: int, sentences: dict[str, str] = SENTENCES, vary: bool = False) -> None:
        """``vary``: texts are longer, and names come again more often and in other forms (an ending, a letter less, one part alone)."""
        self.rnd, self.sentences, self.vary = random.Random(seed), sentences, vary
        self.deck: list[str] = []
        self.rounds = 0

    def _word(self, tails: list[str]) -> str:
        r = self.rnd
        return r.choice(HEADS) + r.choice(MIDS) + r.choice(tails)

    def name(self, lang: str) -> str:
        r = self.rnd
        first, last = self._word(FIRST_TAILS), self._word(LAST_TAILS)
        if r.random() < 0.15:
            last += "-" + self._word(LAST_TAILS)
        if r.random() < 0.05:
            last = r.choice(["van ", "de ", "von ", "Di ", "O'", "Mc", "da "]) + last
        kind = r.random()
        title = r.choice(TITLES[lang].split())
        if kind < 0.38:
            s = f"{first} {last}"
        elif kind < 0.5:
            s = f"{first} {self._word(r.choice([FIRST_TAILS, LAST_TAILS]))} {last}"
        elif kind < 0.62:
            s = f"{first[0]}. {last}"
        elif kind < 0.74:
            s = f"{title} {last}"
        elif kind < 0.8:
            s = f"{title} {first} {last}"
        elif kind < 0.92:
            s = f"{last}, {first}"
        else:
            s = last
        return self._cased(s)

    def _cased(self, s: str) -> str:
        x = self.rnd.random()
        return s.lower() if x < 0.1 else s.upper() if x < 0.18 else s

    def town(self) -> str:
        return self.rnd.choice(HEADS + STREETS) + self.rnd.choice(TOWN_TAILS)

    def street_name(self) -> str:
        return self.rnd.choice(STREETS) if self.rnd.random() < 0.5 else self._word(LAST_TAILS)

    def address(self, lang: str) -> str:
        r = self.rnd
        n = str(r.randint(1, 260)) + (r.choice("abcBC") if r.random() < 0.15 else "")
        s, town, code = self.street_name(), self.town(), f"{r.randint(1000, 99999):05d}"
        form = lang if r.random() < 0.85 else r.choice(list(SENTENCES))
        if form == "en":
            out = f"{n} {s} {r.choice('St. Street Road road Lane Row Avenue Ave. Close Drive Way Court Place'.split())}"
            if r.random() < 0.25:
                out += f", {r.choice(['Apt', 'Flat', 'Unit', 'Apt.'])} {r.randint(1, 40)}"
            tail = f",{r.choice([' ', ' ', chr(10)])}{town}" + (f" {code}" if r.random() < 0.5 else "")
        elif form == "fr":
            out = f"{n} {r.choice(['rue', 'avenue', 'boulevard', 'place'])} {r.choice(['des ', 'du ', 'de la ', 'de ', ''])}{s}{r.choice(['', 's'])}"
            tail = f", {code} {town}"
        elif form == "es":
            out, tail = f"{r.choice(['Calle', 'Avenida', 'Plaza', 'C/', 'Paseo'])} {s} {n}", f", {r.choice(['', code + ' '])}{town}"
        elif form == "it":
            out, tail = f"{r.choice(['Via', 'Viale', 'Piazza', 'Corso'])} {s} {n}", f", {r.choice(['', code + ' '])}{town}"
        elif form == "pt":
            out, tail = f"{r.choice(['Rua', 'Avenida', 'Praça', 'Travessa'])} {s}, {n}", f", {r.choice(['', code + ' '])}{town}"
        elif form == "de":
            out = r.choice([f"{s}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ring'])} {n}", f"{r.choice(['Am', 'Im', 'An der', 'Zum'])} {s} {n}"])
            tail = f"{r.choice([',', ' in', ','])} {code} {town}"
        else:
            out, tail = f"{s}{r.choice(['straat', 'laan', 'weg', 'plein', 'gracht', 'kade'])} {n}", f"{r.choice([',', ' in', ','])} {code} {town}"
        return out + (tail if r.random() < 0.72 else "")

    def email(self, lang: str) -> str:
        r = self.rnd
        a, b = self._word(FIRST_TAILS).lower(), self._word(LAST_TAILS).lower()
        user = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{b}_{a}", f"{a}-{b}", f"{a}{r.randint(0, 99):02d}"]) + ("+reports" if r.random() < 0.2 else "")
        domain = r.choice(DOMAINS)
        x = r.random()
        if x < 0.08:
            return f"{user} {r.choice(['[at]', '(at)'])} {domain}"
        if x < 0.16:
            return f"{user} {r.choice(['(at)', 'at', '[at]'])} {domain.replace('.', ' dot ')}"
        out = f"{user}@{domain}"
        return out.upper() if x < 0.24 else f"mailto:{out}" if x < 0.3 else f"<{out}>" if x < 0.4 else out

    def _digits(self, pattern: str) -> str:
        return re.sub("9", lambda _: str(self.rnd.randint(0, 9)), pattern)

    def phone(self, lang: str) -> str:
        return self._digits(self.rnd.choice(PHONES))

    def id_number(self, lang: str) -> str:
        letters = lambda s: re.sub("A", lambda _: self.rnd.choice("ABCDEFGHJKLMNPRSTWXYZ"), s)
        return letters(self._digits(self.rnd.choice(IDS)))

    def label(self) -> str:
        """A word of a firm's or product's name."""
        return self.rnd.choice(WORDS) if self.rnd.random() < 0.6 else self._word(LAST_TAILS + TOWN_TAILS + FIRST_TAILS)

    def plain(self, pattern: str) -> str:
        r = self.rnd
        fill = {
            "firm": lambda: f"{self.label()} {r.choice([self.label() + ' ', '& ' + self.label() + ' ', ''])}{r.choice([r.choice(FIRMS), r.choice(FIRMS), '& Co.'])}",
            "product": lambda: f"{self.label()} {self.label()}" + (f" {self.label()}" if r.random() < 0.3 else ""),
            "code": lambda: self._digits(r.choice(["SO-9999-999999", "AX-9999", "INV-99999", "PO-99-9999"])),
            "long": lambda: self._digits("4999999999"),
            "build": lambda: self._digits(r.choice(["9.99.999", "4.19.9.99"])),
            "batch": lambda: self._digits(r.choice(["999-99-9999b", "999-99-9999a", "99-999c"])),
            "card": lambda: self._digits(r.choice(["c999@v99", "c99@v9"])),
            "word": lambda: r.choice("total amount orders products sku region refunds name status".split()),
            "region": lambda: r.choice(REGIONS),
            "date": lambda: self._digits("202") + f"{r.randint(4, 6)}-{r.choice(['1299', '0199', '12-1' + str(r.randint(0, 9)), '11-0' + str(r.randint(1, 9))]).replace('99', str(r.randint(10, 30)))}",
            "n": lambda: str(r.choice([3, 5, 10, 20, 40, 99.9, 125, 1000])),
            "year": lambda: str(r.randint(2023, 2026)),
        }
        return re.sub(r"\{(\w+)\}", lambda m: fill[m[1]](), pattern)

    def _again(self, name: str) -> str:
        if not self.vary:
            return name
        words = name.split(" ")
        word = max(words, key=len)
        x = self.rnd.random()
        if x < 0.2:
            return f"{name}'s"
        if x < 0.4 and len(word) > 5:
            i = self.rnd.randint(1, len(word) - 2)
            return name.replace(word, word[:i] + word[i + 1 :])
        return word if x < 0.7 else name

    def sentence(self, lang: str) -> list[tuple[str, str | None]]:
        """(text, kind or None) pieces of one sentence."""
        out: list[tuple[str, str | None]] = []
        for piece in re.split(r"(\{\w+\})", self.rnd.choice(self.sentences[lang].split("\n"))):
            kind = piece[1:-1] if piece.startswith("{") else None
            out.append((getattr(self, kind)(lang), kind) if kind else (piece, None))
        return [p for p in out if p[0]]

    def _dealt(self, backgrounds: list[str]) -> str:
        """The next of the backgrounds in random order; none comes again before all have come."""
        if not self.deck:
            self.deck = self.rnd.sample(backgrounds, len(backgrounds))
        clause = self.deck.pop()
        self.rounds += not self.deck
        return clause

    def dealt_all(self, backgrounds: list[str]) -> bool:
        """Whether each of the backgrounds stands in a text that was made."""
        return not backgrounds or self.rounds > 0

    def text(self, backgrounds: list[str]) -> list[tuple[str, str | None]]:
        """A text of a few sentences, with and without personal information."""
        r = self.rnd
        lang = r.choice(list(self.sentences))
        out: list[tuple[str, str | None]] = []
        names: list[str] = []
        for _ in range(r.choice([3, 4, 5, 6] if self.vary else [1, 1, 2, 2, 3, 4])):
            if r.random() < 0.45:
                part = self.sentence(lang)
                if names and r.random() < (0.8 if self.vary else 0.4):  # the same person again
                    part = [(self._again(r.choice(names)), k) if k == "name" else (t, k) for t, k in part]
                names += [t for t, k in part if k == "name"]
            elif backgrounds and r.random() < 0.75:
                part = [(self._dealt(backgrounds), None)]
            else:
                part = [(self.plain(r.choice(PLAIN.split("\n"))), None)]
            if out:
                out.append((r.choice([" ", " ", "\n", " - ", "\n\n- "]), None))
            out += part
        x = r.random()
        return [(t.lower(), k) for t, k in out] if x < 0.06 else [(t.upper(), k) for t, k in out] if x < 0.1 else out


# Forms of phone and identity numbers (9 any digit, A any letter).
PHONES = ["+1 202-555-9999", "+12025559999", "(202) 555-9999", "202.555.9999", "202 555 9999", "202 555 9999 ext. 99", "+99 99 99999 999", "+99 9 99 99 99 99", "+99 99 9999 9999", "+99 999 999 999", "0099 99 9999 9999", "099/99999999", "0999 999999", "09.99.99.99.99", "09 99 99 99 99", "555-9999", "+99 999 9999999", "+99-99-9999-9999"]
IDS = ["999-99-9999", "999 99 9999", "99999999-A", "A9999999A", "AA9999999", "AA999999A", "AA 99 99 99 A", "999.999.999-99", "9 99 99 99 999 999 99", "999999999", "99.999.999-9", "99999999A", "A99999999", "AA99999AA"]
