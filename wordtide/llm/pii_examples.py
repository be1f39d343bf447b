"""The small labelled table from which the tagger of ``pii`` learns: clauses with marked spans, written out by a rule.

Every value and every clause is invented for this table; none is taken from the tables that the tagger is run on, which
``tests/llm/test_models.py`` checks. In a clause ``{}`` stands for a span; decoys look alike and are of no kind. Lines of
ordinary text, which have no spans, come from the caller.
"""

from __future__ import annotations

import random
import re

from wordtide.llm.language_id import ROMAN

KINDS = ("email", "phone", "id_number", "address", "name")

GIVEN = (
    "Andrew Beatrix Cedric Dorothy Edmund Fiona Gareth Harriet Isaac Judith Kenneth Lorna Magnus Nora Oswald Paula Quentin Rachel Stuart Tamsin Ursula Victor Wendy "
    "Xavier Yvonne Zachary Adebayo Chiamaka Kofi Abena Fatima Khalid Noor Tariq Zainab Arjun Deepak Lakshmi Priya Sanjay Chen Mei Haruto Yuki Minjun Seo-yeon Budi Dewi "
    "Agus Elif Emre Zeynep Kemal Alejandro Beatriz Carmen Joaquín Marisol Ramón Thiago Leticia Rafael Bruna Antoine Camille Étienne Margaux Heinrich Liesel Matthias Ute "
    "Mikhail Svetlana Dmitri Katya Piotr Agnieszka Miriam Gideon Joy Faith Dawn Ivy Jack Penny Violet Ruby Iris Robin Heather"
).split()
FAMILY = (
    "Abernathy Bellweather Cartwright Dunwoody Ellington Fairbairn Gallagher Hargreaves Ingleby Jephson Kilbride Lattimore Montague Northcott Osgood Pemberton Quigley "
    "Rutherford Sedgwick Tattersall Underhill Venables Whitcombe Yardley Owusu Chukwu Diallo Mensah Nakamura Fujimoto Hwang Nguyen Wijaya Santoso Yıldız Demirci "
    "Aguilar Benítez Castellanos Peralta Montoya Cardoso Figueiredo Nogueira Beaumont Delacroix Lefèvre Moreau Baumgartner Eisenhauer Krämer Vogelsang Petrenko "
    "Kowalski Wiśniewski Chatterjee Iyer Rahman Whitlock Parker-Hale Lund-Meyer Costa-Lima McAllister O'Brien D'Angelo"
).split()
PARTICLES = ("de", "de los", "van den", "ter", "dos", "von der", "di", "al", "le", "du")
CYRILLIC_GIVEN = "Алексей Борис Виктор Галина Дмитрий Елена Зоя Игорь Кирилл Лариса Максим Наталья Павел Роман Светлана Тимур Юлия Яна".split()
CYRILLIC_FAMILY = "Абрамов Воронов Гордеев Дроздов Ефимов Журавлёв Казаков Лебедев Морозов Никитин Орлов Романов Соколов Титов Фомин Яковлев".split()
TITLES = ("Dr", "Dr.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Prof.", "Professor", "Sir", "Herr", "Frau", "Señor", "señora", "Sra.", "Dona", "M.", "Mme", "Madame", "Bay", "Pak", "Ibu")
STREETS = ("Hawthorn", "Chestnut", "Elmwood", "Station", "Market", "Kingfisher", "Sycamore", "Lower Wharf", "Windmill", "South Bank", "Fountain", "Thistle", "Orchard", "Upper Green", "Granary")
STREET_KINDS = ("Street", "Road", "Lane", "Ave", "Avenue", "Drive", "Court", "Blvd", "Close", "Way", "St", "Rd", "Row", "Place", "Terrace", "Crescent", "Square", "Hill")
TOWNS = ("Brackenford", "Port Selwyn", "Ashcombe", "Millhaven", "Stonebridge", "Lower Tarn", "Glenmoor", "Novaravia", "Castelbruna", "Havelstadt")
#: Streets as other languages write them; ``{}`` is the house number.
FOREIGN_STREETS = (
    "{} rue des Acacias", "{} rue de la Fontaine", "{} avenue du Château", "{}, chemin des Vignes", "Calle de la Luna {}", "Calle del Olivo {}", "Avenida de la Constitución, {}",
    "Plaza Mayor {}", "Rua das Acácias, {}", "Rua do Carmo, {}", "Avenida das Palmeiras, {}", "Travessa da Glória {}", "Eichenweg {}", "Schillerstraße {}", "Am Bahnhof {}",
    "Mühlgasse {}", "Kirchplatz {}", "ул. Зелёная, д. {}", "ул. Морская, д. {}", "пр. Мира, {}", "переулок Тихий, дом {}", "Atatürk Caddesi No: {}", "Gül Sokak No. {}",
    "Jalan Mawar No. {}", "Jl. Anggrek {}", "Via Verdi {}", "شارع النيل {}", "गांधी मार्ग {}",
)
UNITS = (", apt. {}", ", Apt {}", ", flat {}", ", unit {}", " - apto {}", ", кв. {}", ", {}º B", ", {}º A", ", {}. Stock", ", daire {}", " #{}")
BOXES = ("P.O. Box {}", "PO Box {}", "P. O. Box {}", "Postfach {}", "Apartado {}", "Caixa Postal {}", "BP {}", "а/я {}")

PHONES = (
    "+99 99 99999-999", "+99 9 99 99 99 99", "+99999999999", "+9 (999) 999-9999", "+99 9999 999 999", "+99 (9)99 9999 9999", "999-999-9999", "999.999.9999",
    "(999)9999999", "(999) 999-9999", "9 999 999 9999", "99999 999999", "9999-9999-999999", "99 99 99 99 99", "999 / 99999 999", "+9 999 999 9999", "+99 999 9999999",
    "0099 99 99999999", "0099-9999-999999", "+99 (99) 99999-9999", "999 99 99 99", "+999 999 999 999", "9-999-999-99-99",
    "099 99999999", "099/9999999", "099 999 9999", "0999 999 99 99", "09 99 99 99 99", "8 (999) 999-99-99", "010-9999-9999", "099-9999-9999", "0899 9999 9999", "0899-9999-999", "+99 999-9999-9999", "+99 99999 99999",
)
#: What a number is called, which stays readable, and its form; A stands for a letter, 9 for a digit.
IDS = (
    "SSN |999-99-9999", "SSN: |999-99-9999", "social security |999-99-9999", "social security |999 99 9999", "CPF |999.999.999-99", "CPF: |99999999999", "DNI |99999999A", "NI number |AA 99 99 99 A",
    "NINO |AA999999A", "insurance number |AA 99 99 99 A", "passport |AA9999999", "passport |AA 999 9999", "passport no. |AA9999999", "passport number |999999999", "tax id |99-9999999", "taxpayer number |99-9999999",
    "Steuer-ID |99 999 999 999", "Steuernummer |999/999/99999", "national id |9999-9999-9999", "ID |9999 9999 9999", "identity number |99999999999", "ID no. |99999999999", "NIF |99999999A",
    "NIE |A9999999A", "Ausweis Nr. |A99999999", "Personalausweis |AA9999999", "Reisepass |A99999999", "Führerscheinnummer |A99999999", "Versichertennummer |A999999999", "Sozialversicherungsnummer |99 999999 A 999", "carte nationale |999999999999",
    "numéro de sécu |9 99 99 99 999 999 99", "cédula |9.999.999.999", "Aadhaar |9999 9999 9999", "आधार |9999 9999 9999", "TC kimlik |99999999999", "паспорт |9999 999999", "паспорт серия |99 99 999999", "СНИЛС |999-999-999 99",
    "ИНН |999999999999", "driving licence |AA999999A", "licence no. |AA99 99999", "RG |99.999.999-9", "KTP |9999999999999999", "NIK |9999999999999999", "رقم الهوية |9999999999", "マイナンバー |9999 9999 9999", "주민번호 |999999-9999999",
)
#: What may stand between the name and the number.
LINKS = (": ", " - ", " is ", " nr ", " nr. ", " no. ", " no. ", " no ", " #", " № ", " number ", " = ", " (", " es ", " ist ", " est ", " é ")
#: What is counted, and how amounts are written.
UNITS_COUNTED = ("streams", "clicks", "copies", "people", "steps", "listens", "abonnés", "Zuschauer", "pasos", "tayangan", "kişi", "шагов")
AMOUNTS = ("9 999 999", "99 999 999", "999 999", "9,999,999", "99.999", "9.999.999", "999,999,999", "9999999", "9 999")
DECOYS = (
    "parcel 9999-99-9999", "promo AA-9999-9999", "gate 99-9999", "line 999 at 9.99", "split 9:99.999", "we lost 9-9", "under $99.99", "build 99.9.99.9",
    "since 2099-99-99", "until 99:99:99", "week 99", "volume 9", "99 thumbs up", "receipt no. 99999", "model A9-999", "raffle 9999999", "99/99/2099", "99%", "world seed 999999", "isbn 999-9-99-999999-9",
    "item AA9999999", "order 99999999", "sku 99999999A", "tracking AA999999999AA", "€9.999,99", "9999 x 9999 px", "serial 9999-9999-9999", "lat 99.99999, lon 9.99999", "99 km in 9:99:99", "row 99 seat 9",
)
#: Clauses around a span, for each kind in the twelve languages.
CLAUSES = {
    "email": (
        "reach me at {}", "my inbox is {}", "drop a line to {} about prints", "questions go to {} first", "you can email {} or just comment", "business: {}", "send the invoice to {} today", "booking → {}", "({})", "{}",
        "e-mail: {}", "Fragen bitte per Mail an {}", "meine Adresse ist {}", "para contrataciones: {}", "el correo de mi hermana es {}", "pour les devis : {}", "mon adresse {} marche toujours", "contato comercial {}", "manda e-mail pra {}",
        "hubungi {} untuk kerja sama", "kirim ke {} ya", "iş birliği için {} yeter", "bana {} üzerinden ulaş", "по вопросам рекламы {}", "моя почта {}", "للتواصل {}", "راسلني على {}", "संपर्क {} पर करें", "ईमेल {}", "お問い合わせは {} まで", "연락은 {} 으로",
    ),
    "phone": (
        "ring {} before noon", "my cell is {}", "for tickets dial {}", "hotline {}", "new number: {}", "SMS to {}", "you can reach the shop on {}", "fax {}", "{}", "Tel: {}", "mobile {}", "the office line {} is open",
        "Telefon {}", "unter {} erreichbar", "meine Handynummer lautet {}", "teléfono de la tienda: {}", "mándame un mensaje al {}", "mon numéro est le {}", "téléphone : {}", "meu celular é {}", "chama no {}",
        "nomor saya {}", "telepon {} saja", "numaram {}", "telefon: {}", "мой номер {}", "телефон {}", "اتصل على {}", "هاتف {}", "मेरा नंबर {}", "फोन {}", "電話は {} です", "전화 {}",
    ),
    "id_number": (
        "someone dropped a card with {}", "his {} was on the screen", "never post {} online", "the form says {}", "I blurred {} too late", "found near the bus stop: {}", "{}", "her {} leaked", "scan shows {}", "my {}",
        "auf dem Foto steht {}", "mein {} ist sichtbar", "se ve {} en la foto", "perdí mi cartera, {}", "on voit {} sur la photo", "j’ai perdu {} hier", "perdi meus documentos, {}", "aparece {} no vídeo",
        "terlihat {} di video", "kartta {} yazıyor", "на фото виден {}", "потерял документы: {}", "ضاعت بطاقتي {}", "कार्ड पर {} लिखा है", "カードに {} と書いてある", "카드에 {} 라고",
    ),
    "address": (
        "the studio is on {}", "come by {} on Friday", "mail goes to {}", "our new shop: {}", "filmed outside {}", "rehearsal in {} behind the church", "yard sale, {}", "pick it up from {} after lunch", "I grew up at {}", "{}", "visit us: {}",
        "unser Laden: {}", "ihr findet uns {}", "das Atelier liegt {}", "nuestra tienda está en {}", "mandad cartas a {}", "la boutique se trouve {}", "venez nous voir : {}", "a loja fica na {}", "mandem cartas para {}",
        "toko kami di {}", "alamat: {}", "dükkan {} adresinde", "adresimiz {}", "наш магазин: {}", "живём по адресу {}", "عنواننا {}", "हमारी दुकान {} पर", "住所は {} です", "주소는 {} 입니다",
    ),
    "name": (
        "the cup was handed over by {} at noon", "the cellist is {}", "we all miss {}", "congratulations {}", "{} won the race", "{} and I built this", "guest: {}", "starring {}", "music by {}", "interview with {} about the storm",
        "{} taught me this trick", "I met {} at the fair", "so proud of {}", "drawn by {} without a break", "voice: {}", "according to {}, it works", "my uncle {} cooked", "a big hug for {}", "producer {} told us", "{}’s last concert", "special guest {} on stage",
        "kudos to {}", "greetings to {}", "Grüße an {}", "un grand bravo à {}", "bisous à {}", "saludos a {}", "un abrazo a {}", "abraço para {}", "unser Kameramann heißt {}", "Musik von {}", "{} hat das gebaut", "mit {} auf der Bühne", "el ganador fue {}", "mi profesora {} me enseñó", "entrevista con {}", "voz de {}", "la voix de {}", "mon ami {} conduit", "avec {} au piano", "montage : {}",
        "parabéns {}", "meu professor {} explicou", "edição de {}", "teman saya {} ikut", "bersama {} di panggung", "hocam {} anlattı", "konuk: {}", "{} ile röportaj", "монтаж: {}", "наш гость {}", "песня от {}", "с днём рождения, {}", "мой друг {} помог",
        "مع {}", "मेरे दोस्त {} के साथ", "ゲストは {} です", "게스트 {}",
    ),
}
#: What may follow a span.
TAILS = (
    "for everything", "for the cake", "für alles", "pour tout", "pour le gâteau", "por todo", "por el pastel", "por ajudar", "walked home", "said no", "won again", "est parti", "kam später", "llegó tarde",
    "for questions", "if you can", "from nine to five", "and say hi", "on weekdays", "before it closes", "every time", "who stayed up all night", "again", "so be kind", "jeden Montag", "wenn es regnet", "cuando quieras", "y nada más",
    "quand tu veux", "depuis lundi", "quando puder", "até sexta", "sampai sore", "her zaman", "в любое время", "каждый вечер",
)
#: The same cues with nothing to hide: mentions, handles, places, shows.
PLAIN = (
    "reach me any time", "my inbox is full", "ring before noon", "hotline is closed", "someone dropped a card", "never post it online", "the studio is on a boat", "come by on Friday", "the cup was handed over at noon", "the cellist is tired",
    "congratulations to all of us", "guest: everyone", "starring my old bike", "music by @{handle}", "voice: @{handle}", "hi @{handle}, look", "@{handle}", "@{handle}#loop", "with @{handle} and @{handle}", "clip at https://clips.example/@{handle}",
    "premiere of {title}", "{title}", "{title} is out", "live from {town}", "we drove to {town}", "on tour: {title}, {title}", "tickets for {title} at {title}", "the {title} was loud", "{title}: {plain}", "{plain} ({title})", "welcome to {town}", "{town} by night",
    "winter2031", "hope will rise and joy will stay", "the robin sang at dawn in the heather", "ruby red iris and violet sky", "will you mark my grave with a penny", "we watched a hunter chase the summer rose", "street food on the road", "a lane by the market square",
    "Musik aus dem Keller", "das Haus von gestern und die Straße", "la calle estaba vacía", "el ganador fue nadie", "la voix de la mer", "il a vu de la neige", "parabéns a todos", "rua sem saída", "terima kasih semua", "herkese selam", "всем привет", "شكرا لكم", "सबको नमस्ते", "みんなありがとう", "모두 고마워",
)
ADJECTIVES = "Silver Crimson Hidden Broken Grand Frozen Velvet Ancient Royal Happy Wild Electric Lonely Northern Sunny Secret Paper Green Last Second".split()
NOUNS = "Harbor Valley Circus Museum Theatre Marathon Carnival Cup League Academy Bridge Tower Park Café Records Kitchen Garden Express Parade Kingdom Galaxy Awards Station Street Road Night Story".split()


def _digits(r: random.Random, form: str) -> str:
    return "".join(r.choice("0123456789") if c == "9" else r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else c for c in form)


def _form(r: random.Random, form: str) -> str:
    """Digits for 9; letters for A where only these stand."""
    return re.sub(r"(?<![^\W\d_])A{1,2}(?![^\W\dA_])|9+", lambda m: _digits(r, m[0]), form)


def _id(r: random.Random) -> tuple[str, str]:
    lead, form = r.choice(IDS).split("|")
    case = r.random()
    lead = lead.upper() if case < 0.1 else lead.lower() if case < 0.25 else lead
    return lead if r.random() < 0.55 else lead.rstrip(": ") + r.choice(LINKS), _digits(r, form)


def _word(r: random.Random) -> str:
    return "".join(r.choice("bdfgjklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))


def _family(r: random.Random, hints: dict[str, list[str]]) -> str:
    """A family name, sometimes one of the hints, sometimes one that no list has."""
    if hints.get("family") and r.random() < 0.35:
        return r.choice(hints["family"])
    return r.choice(FAMILY) if r.random() < 0.6 else (_word(r) + r.choice(("", "n", "son", "berg", "ski", "ez", "ell"))).capitalize()


def _given(r: random.Random, hints: dict[str, list[str]]) -> str:
    if hints.get("given") and r.random() < 0.5:
        return r.choice(hints["given"])
    return r.choice(GIVEN) if r.random() < 0.8 else _word(r).capitalize()


def _email(r: random.Random) -> str:
    given, family = r.choice(GIVEN).lower().replace("-", ""), _family(r, {}).lower().replace("-", "").replace("'", "")
    number = str(r.randint(1, 99))
    local = r.choice((f"{given}.{family}", f"{given}_{family}", f"{given}+{_word(r)}", f"{given[0]}{family}", f"{family}{number}", f"{given}.{family}.{number}", f"x.{given}.{family}", f"{_word(r)}-{family}", f"{given}-{family}", f"{given}{number}", _word(r)))
    labels = r.choice(([_word(r), "example"], [_word(r), _word(r), "test"], ["studio-" + _word(r), "com"], ["mail", _word(r), "org"], [_word(r), "net"]))
    kind = r.random()
    at, dot = ("@", ".") if kind < 0.6 else (r.choice((" @ ", " [at] ", " (at) ", " at ", " AT ", "＠", "[at]", " (AT) ")), r.choice((".", ".", " dot ", " (dot) ", " [dot] ", " DOT ")))
    out = local + at + dot.join(labels)
    out = out.upper() if r.random() < 0.08 else out
    return "www." + out if kind < 0.02 else out


def _address(r: random.Random) -> str:
    n = str(r.choice((r.randint(1, 9), r.randint(10, 99), r.randint(100, 399)))) + r.choice(("", "", "", "a", "b", "c"))
    kind = r.random()
    town = r.choice(("", "", f", {r.choice(TOWNS)}", f", {r.choice(TOWNS)} {_form(r, r.choice(('AA9 9AA', '99999', 'A9A 9A9', '9999 AA')))}", f", {r.randint(10000, 99999)} {r.choice(TOWNS)}"))
    if kind < 0.15:
        return r.choice(BOXES[: r.choice((3, len(BOXES)))]).format(r.randint(1, 9999)) + town
    if kind < 0.5:
        street = r.choice(FOREIGN_STREETS).format(n) if r.random() < 0.8 else f"{_word(r).capitalize()}{r.choice(('weg', 'straße', 'gasse', 'allee', 'platz'))} {n}"
    else:
        street = f"{n} {r.choice(('', '', '', 'N. ', 'E. ', 'South '))}{r.choice(STREETS) if r.random() < 0.6 else _word(r).capitalize()} {r.choice(STREET_KINDS)}"
        if r.random() < 0.1:
            street = f"{r.choice(('Flat', 'Unit', 'Suite', 'Apt'))} {r.randint(1, 40)}, {street}"
    unit = r.choice(UNITS).format(r.randint(1, 90)) if r.random() < 0.25 else ""
    return street + unit + town


def _name(r: random.Random, hints: dict[str, list[str]]) -> str:
    if r.random() < 0.14:
        given, family = r.choice(CYRILLIC_GIVEN), r.choice(CYRILLIC_FAMILY)
        return f"{given} {family}{'а' if given[-1] in 'ая' else ''}"
    given, family = _given(r, hints), _family(r, hints)
    if r.random() < 0.2:
        family = f"{r.choice(PARTICLES)} {family.split('-')[0]}"
    forms = (
        *[f"{given} {family}"] * 6, f"{given} {r.choice('ABCDEFGJKLMOPRSTVW')}. {family}", f"{r.choice(TITLES)} {family}", f"{r.choice(TITLES)} {given} {family}",
        f"{family.upper()}, {given}", *[f"{given} {family}".lower()] * 2, f"{given} {family}".upper(), f"{r.choice('ABCDEFGHJKLM')}. {family}",
    )
    return r.choice(forms)


def _title(r: random.Random, ordinary: list[str]) -> str:
    """The name of a show, a place or an event: ordinary words with capitals."""
    if ordinary and r.random() < 0.3:
        return " ".join(r.choice(ordinary).capitalize() for _ in range(r.choice((1, 2, 2, 3))))
    return " ".join([r.choice(ADJECTIVES), *r.sample(NOUNS, r.choice((1, 1, 2)))])


def _wide(text: str) -> str:
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def _handle(r: random.Random) -> str:
    return r.choice((_word(r), f"{_word(r)}.{_word(r)}", f"user{r.randint(1, 10**9)}"))


def _fill(r: random.Random, template: str, plain: list[str], ordinary: list[str]) -> str:
    """A clause without spans, written out."""
    made = {"title": lambda: _title(r, ordinary), "town": lambda: r.choice(TOWNS), "handle": lambda: _handle(r), "plain": lambda: r.choice(plain) if plain else _word(r)}
    return re.sub(r"\{(\w+)\}", lambda m: made[m[1]](), template)


def _clause(r: random.Random, plain: list[str], ordinary: list[str], hints: dict[str, list[str]]) -> list[tuple[str, str | None]]:
    """Parts of a clause with their kinds."""
    draw = r.random()
    if draw < 0.03:
        return [(f"{_form(r, r.choice(AMOUNTS))} {r.choice(UNITS_COUNTED)}", None)]
    if draw < 0.3 or not plain and draw < 0.5:
        return [(_fill(r, r.choice(PLAIN), plain, ordinary) if r.random() < 0.55 else _form(r, r.choice(DECOYS)), None)]
    if draw < 0.54 and plain:
        line = r.choice(plain)
        return [(line.upper() if r.random() < 0.15 else line, None)]
    if draw < 0.58 and plain:
        return [(_garbled(r, r.choice(plain)), None)]
    kind = r.choice((*KINDS, "name"))
    before, after = r.choice(CLAUSES[kind]).split("{}")
    if r.random() < 0.25:
        before = before[:1].upper() + before[1:]
    parts: list[tuple[str, str | None]] = [(before, None)]
    if kind == "id_number":
        lead, body = _id(r)
        parts += [(lead, None), (body, kind)]
    else:
        value = {"email": _email, "phone": lambda r: _form(r, r.choice(PHONES)), "address": _address, "name": lambda r: _name(r, hints)}[kind](r)
        parts.append((_wide(value) if kind in ("phone", "email") and r.random() < 0.06 else value, kind))
    parts.append((after, None))
    if not after and r.random() < 0.5:
        parts.append((r.choice((" ", " ", ", ")) + r.choice(TAILS), None))
    return [p for p in parts if p[0]]


def _noise(r: random.Random, text: str) -> str:
    """The same with as many characters, so that spans hold: all in capitals, or with letters lost."""
    if r.random() < 0.7:
        return "".join(u if len(u := c.upper()) == 1 else c for c in text)
    return "".join("�" if ord(c) > 127 and c.isalpha() else c for c in text)


def _garbled(r: random.Random, line: str) -> str:
    """A line without spans, decoded with a wrong encoding once or twice, in Latin letters, or tags without blanks."""
    if r.random() < 0.3:
        return "".join("#" + _word(r) for _ in range(r.randint(2, 4)))
    if any("а" <= c <= "я" for c in line) and r.random() < 0.4:
        return "".join(ROMAN.get(c, ROMAN.get(c.lower(), c).capitalize()) for c in line)
    codec = r.choice(("cp1252", "cp1252", "latin-1", "mac_roman", "cp437", "cp866"))
    if any("а" <= c <= "я" for c in line) and r.random() < 0.5:
        return line.encode("koi8-r", "ignore").decode("cp1251", "ignore")[:160]
    for _ in range(r.choice((1, 1, 2))):
        line = line.encode("utf-8", "ignore").decode(codec, r.choice(("replace", "ignore")))
    return line[:160]


def own_words() -> set[str]:
    """Ordinary words of the clauses, in small letters."""
    texts = [*(t for own in CLAUSES.values() for t in own), *TAILS, *PLAIN, *ADJECTIVES, *NOUNS, *STREET_KINDS, *DECOYS]
    return {w for t in texts for w in re.findall(r"[^\W\d_]+", re.sub(r"\{\w*\}", " ", t).lower()) if len(w) > 1}


def labelled(plain: list[str], size: int, hints: dict[str, list[str]] | None = None, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``size`` texts with spans (start, end, kind): one to four clauses each, as descriptions have them. ``hints`` are names
    (``given`` and ``family``) that occur among the invented ones."""
    r = random.Random(seed)
    ordinary = sorted({w for line in plain for w in re.findall(r"[a-z]{3,}", line)})
    out = []
    for _ in range(size):
        text, spans, joint = "", [], r.choice((". ", "\n", " | ", ", ", " "))
        for i in range(r.choice((1, 2, 2, 3, 4))):
            if i:
                text += joint
            for part, kind in _clause(r, plain, ordinary, hints or {}):
                if kind:
                    spans.append((len(text), len(text) + len(part), kind))
                text += part
        if r.random() < 0.08:
            text = _noise(r, text)
        if r.random() < 0.3:
            text += r.choice((" #", " ", " @user", " https://clips.example/")) + _word(r)
        out.append((text, spans))
    return out
