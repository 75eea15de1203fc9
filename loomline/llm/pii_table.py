"""The small labelled table from which the tagger of personal data is trained.

`FAMILIES` are families of labelled sentences, one a situation, all in our own words. A mention is
written as a slot, `{name}` and so on; `{n}`, `{w}`, `{place}`... are filled with unlabelled material.
Slots are filled from the rules below (our own inventions, made by a seeded generator), so a
row of the table is a list of (text, label) pieces. Tests leave whole families out of the
fit and measure on them.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

FAMILIES = {
    "joining": """
Welcome {name} to the {w} group, first day is {date}.
{name} ({id_number}) joins us on Tuesday.
Onboarding list: {name}, {id_number}, laptop ordered.
Please open an account for {name} and print the card for {id_number}.
The contract of {name} carries {id_number}; file it.
Nouveau collègue : {name}, {id_number}.
Neue Kollegin {name} beginnt am Montag.
Se incorpora {name} con {id_number}.""",
    "places": """
She moved from {address} to {address}.
Our new site is at {address}.
Parcels for the {w} go to {address}.
Deliver the switches to {address} before noon.
We meet {name} at {address} on Friday.
{name} now rents a flat at {address}.
My home is {address}; the train takes an hour.
His parents' house, {address}, has no broadband.
Return address: {address}
Anschrift: {address}
Bitte schicken Sie das Paket an {address}.
Wir treffen uns in der {address}.
Merci de livrer au {address}.
Le colis part pour {address}.
La oficina está en {address}.
Enviar el paquete a {address}.
Pick-up point: {address}.
The visit takes place at {address}.
I'm staying at {address} until {date}.""",
    "fields": """
customer={name};phone={phone};street={address}
applicant_name={name}, applicant_phone={phone}
location={address}
home_address={address}
site={address}
full_name={name}
contact_phone={phone}
mobile={phone}
fax: {phone}
phone: {phone}
mail={email};tel={phone}
Name: {name}
Telefon: {phone}
Tel. {phone}
Adresse : {address}
Dirección: {address}
Correo: {email}
user: {name} | mail: {email}
ssn_field={id_number}
doc_id={id_number}; holder={name}""",
    "closings": """
Best,\\n{name}
Kind regards\\n{name}\\n{phone}
Cheers,\\n{name}\\n{email}
Mit freundlichen Grüßen\\n{name}
Cordialement,\\n{name}\\n{phone}
Saludos,\\n{name}
-- \\n{name}, {phone}
Sent by {name}
thank you {name}, well done
many thanks {name}
hello {name}, can you look at the {w}?
Dear {name},\\nthe {w} is ready.""",
    "work": """
Check with {name} first.
Could {name} approve the {w}?
{name} reviewed the {w} and {v2} it.
{name} closed the ticket yesterday.
It was {name} who {v2} the {w}.
I had a call with {name} on the {w}.
Wait for {name} to come back.
According to {name} the {w} is fine.
{name} and {name} share the {w}.
The decision came from {name} in March.
Nobody but {name} may {v} the {w}.
{name} wants the {w} by Thursday.
the {w} belongs to {name} now, no longer to {name}
Der Fehler wurde von {name} gemeldet.
{name} hat den Test {d} wiederholt.
Frag bitte {name} danach.
Selon {name}, le test est bon.
La demande de {name} est close.
{name} demande une copie du rapport.
Según {name}, la tabla está bien.
{name} pide otra revisión.
El cambio lo hizo {name}.
(see the note of {name})
escalated to {name} at {d2}:{d2}
handed over by {name}""",
    "trailers": """
Signed-off-by: {name} <{email}>
Co-developed-by: {name} <{email}>
Tested-by: {name}
Approved: {name}
committer {name} <{email}> {d6} +0200
Author: {name} <{email}>
To: {name} <{email}>
Cc: {email}, {email}
From: {email}
maintainer: {name}
assignee: {name}
git shortlog --committer={email}
git config user.email {email}
CODEOWNERS {email} src/{w2}.py""",
    "mails": """
My mail is {email}.
{email} can't open the {w}.
Forward the {w} to {email} please.
The message to {email} came back.
Ask {email} for access to the {w}.
Any news from {email}?
owner: {email}
contact={email} level={d}
{{"to": "{email}", "retry": {d}}}
{{"reporter": "{email}"}}
"mail": "{email}"
Schreib bitte an {email}, wenn es fertig ist.
Die Einladung an {email} kam zurück.
Écrivez à {email} avant lundi.
L'alerte est partie vers {email} hier.
Escribe a {email} si falla.
La copia llegó a {email} tarde.
<{email}> wrote:
alerts go to {email} and {email}
login failed for {email} from {ip}""",
    "calls": """
Ring me on {phone} tonight.
You can reach the desk under {phone}.
The hotline {phone} is dead.
{phone} rang twice and nobody answered.
If nothing works, dial {phone}.
Leave a message at {phone}.
call {name} at {phone}
text {phone} or mail {email}
Her number changed to {phone}.
Support: {phone} (weekdays)
Bitte unter {phone} zurückrufen.
Er ist unter {phone} erreichbar.
Appelez le {phone} après dix heures.
On peut me joindre au {phone}.
Mi número es {phone}, por la tarde.
Llama al {phone} si hay dudas.
WhatsApp {phone}
on-call phone {phone}, backup {phone}""",
    "numbers": """
The export still has {id_number} in row {d}.
Mask {id_number} before you share the file.
Somebody typed {id_number} into the search box.
{id_number} must not be in the log.
log: created user with {id_number}
Delete {id_number} from the sample.
The scan shows {id_number} and a photo.
Please verify {id_number} for {name}.
Im Anhang steht {id_number}, bitte schwärzen.
{id_number} taucht im Protokoll auf.
Supprimez {id_number} du fichier.
On voit {id_number} dans l'extrait.
Hay que borrar {id_number} del informe.
El registro muestra {id_number} en claro.
test data: {id_number}
[warn] payload held {id_number}
Line {d3}: {id_number}
form value "{id_number}" rejected""",
    "mixed": """
{name}, {email}, {phone}
{name} - {address} - {phone}
{name} ({phone}) and {name} ({email}) are away.
{w}: {name} lives in {address}. The {w} is calm.
Invoice for {name}, {address}, due {date}
Reach {name} by {phone} or at {email}; papers under {id_number}.
Shipping label {name}\\n{address}\\n{phone}
Visitor {name}, {id_number}, host {name}""",
    "carriers": """
{any}
{any}.
Value: {any}
It says {any} here.
{any} is on the list.
{any} was in the {w}.
{any} left the {w} open.
Remove {any} from the {w}.
My number is {num}, not {num}.
He gave {num} to the clerk.
Bitte {num} aus dem Text nehmen.
They left {num} at the door.
Hier steht {any}.
Voici {any} pour le dossier.
Aquí va {any} otra vez.
note {any} before you {v} the {w}
x={any}
"{any}"
- {any}
{w}: {any}
{any}; {any}
The {w} had {any} in it. Nothing else.
I found {any} when I {v2} the {w}.
Use {num} for now.
{any} / {any}
ref {num} (old)
[{w2}] {any}
{any} {v2} the {w}.""",
    "look-alikes": """
Fast Lane {d} is closed for the nightly run.
Lane {d} of the runner is idle and Gate {d} is open.
Silver Harbor is a code name, {n} rows.
Iron Gate and Quiet Bridge are names of releases.
Northern Tower has {n} rows, Western Mill has none.
The Amber Road release is late.
Issue KD-{d4}-{d2} repeats KD-{d2}.
Ticket PR-{d3}-{d4}: see also PR-{d3}.
Job {d6}-{d1}-{d2} started late.
Batch {d6}-{d2}-{d1} waits.
Invoice {d4}-{d4} was paid.
Part number {d3}-{d2}-{d1} is out of stock.
Release {d1}.{d2}.{d3} fixes the {w}.
Release {d1}.{d3}.{d2} is out, {d1}.{d3}.{d3} follows.
Tag v{d2}.{d3}.{d3} was pushed.
build {d4}.{d2}.{d2}.{d1} is green
Upgrade {w2}-core@{d1}.{d1}.{d2} today.
npm i {w2}@{d1}.{d2}.{d1} --save
pip install {w2}=={d1}.{d2}.{d2}
Add @cached({d2}) above line {d3}.
Decorate it with @{w2}(limit={d}).
Ping @{w2} in the channel.
git fetch git@host.invalid:{w2}/{w2}.git main
clone git@repo.example:{w2}/core.git && run
remote: git@server.test:{w2}.git
ssh deploy@{ip} uptime
scp log.txt root@box:/tmp
Port {d5} is busy; use {d5}.
offset {d6}, length {d4}, delta -{d3}
+{d4} -{d2} in {d1} files
checksum {hex12} matches
merge {hex10}\\n    {v} the {w}
It ran from {date} {d2}:{d2} until {d2}:{d2} and took {d4} ms.
{hex10} lib/{w2}.py {d4} KB
lib/{w2}.md grew to {d5} bytes
revision {hex10}\\n    {v} the {w}\\nlib/{w2}.sh {d4} bytes
uuid {hex8}-{d4}-{d4}-{hex12}
pid {d5} exited with {d1}
timestamp {d10}
epoch={d10} seq={d6}
lat {d2}.{d4}, lon {d2}.{d4}
{d3}-{d4} tokens per row
Server {ip}:{d4} answers.
The list has {d3} 000 rows and {d2} 500 000 bytes.
from {d4} to {d4}, step {d2}""",
    "towns": """
The {place} office is quiet today.
Rain in {place}, so the {w} is late.
We keep a mirror in {place} and one in {place}.
Das Lager in {place} ist voll.
À {place}, tout va bien.
En {place} no hay red.
Trains between {place} and {place} run hourly.
Report from {place}: the {w} is {v2}.""",
    "logs": """
{date} {d2}:{d2}:{d2} DEBUG lib/{w2}.py items={d4} ms={d2}
{date}T{d2}:{d2}:{d2}Z ERROR {w2} code={d3} try={d1}
task_{hex8} done rc={d1} mem={d3}MB
epoch {d2}/{d3} acc=0.{d4} lr=0.00{d2}
[{hex8}] POST /items {d3} {d4}
$ ls -l out/{w2}.csv\\n-rw-r--r-- 1 root root {d5} out/{w2}.csv\\nexit_code: {d1}
Traceback (most recent call last):\\n  File "lib/{w2}.py", line {d3}, in main\\nKeyError: '{w2}'
[info] {w2} up pid={d4}\\n[info] {d3} items\\n[error] {w2} failed after {d2} tries
console.info: {w2} took {d3} ms\\nconsole.error: {w2} missing
$ pytest -k {w2}\\n{d2} passed, {d1} failed in {d2}.{d2}s\\nexit_code: 1
FAILED spec/test_{w2}.py::test_{d2} - AssertionError
ok {d2} - {w2} ({d3} ms)
HTTP {d3} for /api/{w2}/{d4}
error {d3} at {w2}.js:{d3}:{d2}
{{"status":{d3},"message":"quota exceeded","request":"{d5}"}}
cpu={d2}% rss={d3}MB fds={d2}
npm ERR! code E{d3}
WARN {w2}: slow query, {d4} ms""",
    "talk": """
All {d2} checks are green. Nothing is left for the {w}.
How long is the queue? It shows {d4}.
The {w} lists {d2} rows, but the {w} has {d4}.
Finished: the {w} was {v2}, {d2} lines fewer.
After {v3} the {w}, the share rose to {d2} percent.
In total {d4} came in, {d4} went out and {d2} were dropped.
The {w} looks {v2}; {d2} notes are open.
You took the wrong {w}. Take the other one.
Nothing changed since the {w} was {v2}, {d2} minutes ago.
Both results agree apart from the {w}, which lost {d2} rows.
The reason is that the {w} is built again at each start, so the {w} was stale.
First I {v} the {w}, then I open the {w}.
Next: {v} the {w}; I expect {d2} minutes.
I won't {v} src/{w2}.py without a yes from you.
May I go on with {v3} the {w}, or do you want to see it first?
Either we {v} the {w} today or the {w} stays as it is.
What if the {w} hangs for {d2} minutes?
Is the {w} slow, or is it the {w}?
Tell me the price of a smaller {w}, then {v} it.
The log is full, so {v} the {w} soon.
Let another agent do the {w}; keep the {w} away from it.
Take the short way for the {w}.
Last night {d2} turns were lost; look at the {w}.
Keep {d2}% of the money for the {w}.
Fine. Show me the lines you changed in src/{w2}.py.
Leave the {w} alone until the {w} passes.
Halt. Who told you to {v} the {w}?
Every hour: does the {w} rest?
Tests are routine, but ask before you {v} the {w} in {place}.
On Monday the {w} was old. And now?
{d3} runs fail since the cause is hidden.
A short answer and a clean {w}, please.
Wir haben den {w} am Mittwoch geprüft, {d2} Zeilen fehlen.
Le {w} est prêt, il reste {d2} lignes.
La {w} tiene {d2} filas menos.
Sunday, Monday and Tuesday are free.
January February March
Spring Summer Autumn Winter
The United Nations and the European Union agree.
Visual Studio and Open Office are installed.
New York and San Pedro are far away.""",
    "pages": """
Error {d3}: the server gave up
Hi {{{{user}}}}, your {{{{item}}}} is here. <PLACE> [[slot]]
Nothing was found at /p/{d4}.
{d3} Bad Request\\ngate/{d1}.{d3}
The gateway said {d3} three times, so the {w} waits longer.
Service down for repair. Come back later.
503 Service Unavailable, {d3} s
Forbidden. Code {d5}
One moment, we look at your browser. Id {d5}
Start / Search / Contact\\nThat page is gone.\\n(c) {d4}
%d rows were printed as %d; mend conf/{w2}.yaml.
Bitte schalten Sie Skripte ein.
Activez les scripts pour continuer.
Active los scripts para seguir.
Ipsum amet dolor elit magna.""",
}
_WORDS = "parser,dashboard,rollback plan,quote verifier,session store,rate limiter,config reader,test plan,changelog,cache layer,smoke test,status page,review comment,usage table,login page,export script,draft spec,golden set,trace file,runbook,pull request,queue poller,scorecard,migration script,ingest worker,budget gate".split(",")
_NAMES = "score,report,router,windows,masking,register,budget,cursor,pilot,sample,ingest,freeze".split(",")
_VERBS = "split,merge,freeze,measure,rename,profile,document,verify,compare,archive,inspect,simplify".split(",")
_PLACE_A = "Tarn,Pont,Dun,Esk,Marr,Sel,Ober,Quill,Wolv,Fjal,Hald,Brenn,Lind".split(",")
_PLACE_B = "holt,haven,mere,vara,ingen,stedt,caster,owick,brücke,olles,ford,stad".split(",")
_ROAD_A = "Mill,Larch,Copper,Heron,Saddle,Tanner,Orchard,Lantern,Fen,Basalt,Willow,Stone,Mar,Ash".split(",")
_ROAD_B = "gate,more,field,stone,ridge,brook,low,wright,well,side".split(",")
_SYL_A = "Bri,Dor,Fen,Il,Ja,Kes,Lu,Mir,Nym,Or,Sev,Tal,Vel,Zan,Ka,Ro,Ma,El,An,Te".split(",")
_SYL_B = "anka,aro,essa,ette,imer,indel,ithe,osk,ovan,uno,vella,ymir,oric,ella,ian,ena,o,is".split(",")
_FAM_A = "Brask,Greth,Hol,Kard,Mosk,Nax,Ost,Pell,Quar,Strav,Tyn,Ulm,Vuln,Wend,Hart,Lind,Berg".split(",")
_FAM_B = "aumer,ello,hurst,isker,ovane,quist,thorpe,énor,dahl,mark,wick,brandt,öder,son,mann,er".split(",")


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _person(r: random.Random, roster: list[tuple[str, str]]) -> tuple[str, str]:
    if roster and r.random() < 0.5:
        return r.choice(roster)[0], r.choice(roster)[1]
    return r.choice(_SYL_A) + r.choice(_SYL_B), r.choice(_FAM_A) + r.choice(_FAM_B)


def _name(r, roster) -> str:
    g, f = _person(r, roster)
    x = r.random()
    initial = r.choice("ABCDEFGHIJKLMNOPRSTVW")
    if x < 0.34:
        return f"{g} {f}"
    if x < 0.44:
        return f"{g} {f.upper()}"
    if x < 0.54:
        return f"{g} {initial}. {f}"
    if x < 0.66:
        return f"{g[0]}. {f}"
    if x < 0.82:
        return f"{f}, {g}"
    if x < 0.9:
        return f"{g} {f}".upper()
    return f"{g} {f}".lower()


def _email(r, roster) -> str:
    g, f = (x.lower() for x in _person(r, roster))
    g, f = (x.replace("é", "e").replace("ö", "oe") for x in (g, f))
    user = r.choice([f"{g}.{f}", f"{g}-{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}_{_d(r, 2)}", f"{g}+{_d(r, 1)}logs", f"{g}{_d(r, 2)}"])
    host = r.choice(["example.org", "mail.example", "team.example.com", "post.example.net", "corp.test", "dev.invalid", "inbox.example.de", "office.test"])
    x = r.random()
    if x < 0.06:
        return f"{user} @ {host}"
    if x < 0.12:
        return f"{user} [at] {host.replace('.', ' [dot] ')}"
    if x < 0.24:
        return f"{user} (at) {host}"
    if x < 0.34:
        return f"{user}@{host}".upper()
    if x < 0.44:
        return f"mailto:{user}@{host}"
    return f"{user}@{host}"


def _turn(r: random.Random, forms: list[str]) -> str:
    """Forms by turns, so that every sentence meets nearly every form."""
    r.turn = getattr(r, "turn", 0) + 1
    return forms[r.turn % len(forms)]


def _phone(r) -> str:
    d = lambda n: _d(r, n)
    return _turn(r, [
        f"+{r.choice(['49', '33', '34', '44'])} {d(2)} {d(5)} {d(3)}", f"+44 20 {d(4)} {d(4)}", f"+1 {d(3)} 555 {d(4)}", f"+1-{d(3)}-555-{d(4)} ext. {d(3)}", f"({d(3)}) 555-{d(4)}",
        f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}.555.{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(3)}/{d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"+49-{d(2)}-{d(7)}", f"0{d(4)} {d(6)}", f"01{d(3)} {d(6)}", f"01{d(3)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(2)}/{d(8)}", f"0{d(2)}/{d(8)}", f"0{d(2)}/{d(7)}", f"+1{d(3)}555 {d(4)}", f"00 49 {d(2)} {d(5)}-{d(3)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-555-{d(4)}",
    ])


def _id(r) -> str:
    d = lambda n: _d(r, n)
    return _turn(r, [
        f"SSN: {d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"passport number {r.choice('ABCKPX')}{d(7)}", f"passport {d(9)}", f"ID card no. {r.choice('ABLTX')}{d(8)}", f"Personalausweis {r.choice('LTXZ')}{d(8)}", f"Reisepass-Nr. {r.choice('CFGH')}{d(8)}", f"Steuer-ID {d(2)} {d(3)} {d(3)} {d(3)}", f"numéro fiscal {d(2)} {d(2)} {d(3)} {d(3)} {d(3)}", f"carte d'identité {d(2)}{r.choice('ABC')}{d(5)}", f"DNI {d(8)}{r.choice('ABCQRTW')}", f"NIF {d(8)}-{r.choice('ABCQRTW')}", f"VAT ID of a person {d(3)} {d(3)} {d(3)}", f"national insurance number AB {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}",
        f"SSN {d(3)}-{d(2)}-{d(4)}", f"social security number {d(3)} {d(2)} {d(4)}", f"social security no. {d(3)}-{d(2)}-{d(4)}", f"tax number {d(2)}/{d(3)}/{d(5)}", f"SSN {d(3)} {d(2)} {d(4)}", f"passport no. {r.choice('CXLP')}{d(8)}", f"Ausweis-Nr. L{d(2)}X{d(4)}T{d(1)}", f"DNI {d(2)}.{d(3)}.{d(3)}-{r.choice('QRTW')}",
        f"national ID QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"tax number {d(2)}/{d(3)}/{d(4)}", f"passport {r.choice('CXLP')}{d(8)}", f"SSN {d(9)}", f"tax ID {d(2)} {d(3)} {d(3)} {d(3)}", f"Steuernummer {d(2)}/{d(3)}/{d(5)}", f"NIE X-{d(7)}-{r.choice('QRTW')}",
    ])


def _address(r) -> str:
    road, place, n, z = r.choice(_ROAD_A) + r.choice(_ROAD_B), r.choice(_PLACE_A) + r.choice(_PLACE_B), r.randint(1, 220), _d(r, 5)
    return r.choice([
        f"{n} {road} Lane, {place} {z}", f"{road}straße {n}, {z} {place}", f"calle {road} {n}, {z} {place}", f"{n}, rue de {road}, {z} {place}", f"{road}weg {n}a in {z} {place}", f"{n} {road} St., Apt {r.randint(1, 40)}, {place}",
        f"{n} {road} Drive, {place}", f"{n} {road} Close", f"{road}gasse {n}, {z} {place}", f"Am {road} {n}, {z} {place}", f"avenida de {road} {n}, {z} {place}", f"plaza {road} {n}, {place}", f"{n} avenue {road}, {z} {place}", f"{n}, boulevard {road}, {place}", f"{n} {road} Way, Unit {r.randint(1, 40)}, {place} {z}", f"{road} Street {n}, {place}",
        f"{n} {road} Road\n{place} {z}", f"{n} {road} Road", f"{n} {road} Street, {place}", f"{n} {road} Avenue, {place} {z}", f"{road}platz {n}, {z} {place}",
    ])


def _filler(slot: str, r: random.Random) -> str:
    if m := re.fullmatch(r"d(\d*)", slot):
        return _d(r, int(m[1])) if m[1] else str(r.randint(0, 99))
    if m := re.fullmatch(r"hex(\d+)", slot):
        return "".join(r.choice("0123456789abcdef") for _ in range(int(m[1])))
    verb = r.choice(_VERBS)
    if slot == "ip":
        return ".".join(str(r.randint(1, 254)) for _ in range(4))
    return {
        "w": r.choice(_WORDS), "w2": r.choice(_NAMES), "v": verb, "v2": verb.rstrip("e") + "ed", "v3": verb.rstrip("e") + "ing", "n": _d(r, r.randint(1, 4)),
        "place": r.choice(_PLACE_A) + r.choice(_PLACE_B), "date": f"2026-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    }[slot]


_SLOT = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def _row(template: str, r: random.Random, roster) -> list[tuple[str, str | None]]:
    out, at = [], 0
    template = template.replace("\\n", "\n")
    make = {"name": lambda: _name(r, roster), "email": lambda: _email(r, roster), "phone": lambda: _phone(r), "id_number": lambda: _id(r), "address": lambda: _address(r)}
    for m in _SLOT.finditer(template):
        out.append((template[at : m.start()], None))
        at = m.end()
        if not m[1]:
            out.append((m[0][0], None))
        elif m[1] in ("any", "num"):  # a mention of any kind, or of those that are numbers
            kind = r.choice(KINDS if m[1] == "any" else ("phone", "id_number"))
            out.append((make[kind](), kind))
        elif m[1] in make:
            out.append((make[m[1]](), m[1]))
        else:
            out.append((_filler(m[1], r), None))
    out.append((template[at:], None))
    return [(t, k) for t, k in out if t]


def labelled_table(roster: list[tuple[str, str]], seed: int = 5, with_mention: int = 10, without: int = 3, families=None) -> list[list[tuple[str, str | None]]]:
    """The table: each sentence several times, some beside another sentence, as mentions occur in running text. `families` limits it to some."""
    r = random.Random(seed)
    chosen = [s for f, rows in FAMILIES.items() if families is None or f in families for s in rows.strip("\n").split("\n")]
    plain = [s for s in chosen if not any("{" + k + "}" in s for k in (*KINDS, "any", "num"))] or ["Nothing else happened."]
    rows = []
    for s in chosen:
        for _ in range(without if s in plain else with_mention):
            row = _row(s, r, roster)
            x = r.random()
            if x < 0.35:
                row = [*_row(r.choice(plain), r, roster), (r.choice([" ", " ", "\n"]), None), *row]
            elif x < 0.6:
                row = [*row, (r.choice([" ", " ", "\n"]), None), *_row(r.choice(plain), r, roster)]
            rows.append(row)
    return rows
