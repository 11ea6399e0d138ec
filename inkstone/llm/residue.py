"""Template residue and error-page text (problem 10): labelled exemplars, an inverted index, TF-IDF containment.

Labelled exemplars are short phrases from public knowledge: notations of template languages, phrases of
filler, error pages, program errors, script and browser notices, and frames in which a text merely speaks
about such things. Words that mean the same in a notice (in nine languages) are one token, so an exemplar
covers its translations and rewordings; notations, stack frames, HTTP statuses and struck keys are tokens too.

One pass reads the documents: it turns each into the positions of exemplar tokens (a posting list, empty for
most), and counts in how many documents each token stands (one row a task, as long as the vocabulary). The
second stage reads the postings only. The rarest tokens of an exemplar retrieve it; over windows of the
passage it is computed how much of its TF-IDF weight the window contains. For struck keys and made-up Latin
the containment runs the other way: how much of a window's weight the exemplar holds. A window in a sentence
that a frame covers is set aside. Documents with a high-coverage window are excluded.

Defined results: null, empty and blank texts and texts without words are no cases; repeated rows of one
id give one case.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.text_forms import consistent_form
from inkstone.session import materialize

COVERAGE = 0.8
FILLER_RUN = 8
FILLER_SHARE = 0.75
NEAR_FRAME = 14
NEAR_MENTION = 3

# Words that mean the same in a notice, by token, in English and eight other languages.
CONCEPTS = {
    "<script>": "javascript js noscript scripts javascripts скрипты сценарии",
    "<cookie>": "cookie cookies куки",
    "<browser>": "browser browsers webbrowser navigateur navegador navegadores браузер браузере браузера",
    "<enable>": """enable enabled enabling activate activated activating allow accept unblock turn switch switched turned aktivieren aktiviere aktiviert
        einschalten zulassen erlauben activer activez activé activés autoriser autorisez active activa activar activado habilite habilitar habilita permita permitir
        acepte ative ativar ativado ativo permite abilitare abilita abilitate attivare attiva attivate attivo consentire inschakelen ingeschakeld schakel
        включите включить включён включен разрешите""",
    "<off>": """disabled disable blocked blocking off deactivated deaktiviert ausgeschaltet désactivé bloqué desactivado deshabilitado bloqueado desativado
        disattivato disabilitato bloccato uitgeschakeld geblokkeerd отключён отключен отключены""",
    "<need>": """please need needs must require requires required necessary bitte benötigt benötigen erforderlich veuillez merci nécessaire nécessite requis requiere
        necesita necesario necesitas precisa necessário requer necessario richiede richiesto vereist nodig alstublieft требуется необходимо необходим пожалуйста""",
    "<page>": """page site website webpage app application resource content contents seite webseite website inhalt inhalte anwendung contenu página pagina sitio
        contenido conteúdo sito contenuto inhoud страница страницы страницу сайт сайта содержимое""",
    "<view>": """view display continue proceed use access load reload refresh see utilize anzeigen anzuzeigen fortzufahren weiter nutzen afficher continuer accéder
        voir recharger mostrar ver continuar acceder visualizar acessar visualizzare continuare vedere utilizzare bekijken verder gebruiken просмотра просмотреть
        продолжить работы продолжения""",
    "<outdated>": "unsupported outdated incompatible supported compatible veraltet obsolète obsoleto verouderd устарел",
    "<upgrade>": "upgrade update aktualisieren actualiser actualice atualize aggiorna bijwerken обновите",
    "<gone>": """gone missing introuvable inexistente encontrada encontrado trovata trovato gevonden gefunden найдена найден existiert existe esiste bestaat существует
        mistyped""",
    "<sorry>": "sorry oops whoops leider désolé désolés sentimos siento spiacenti helaas извините",
    "<server>": "server host serveur servidor сервер upstream gateway nginx apache",
    "<error>": "error errors erreur fehler errore erro fout ошибка",
    "<sought>": "requested looking seeking url demandée demandé cherchez recherchez solicitada solicitado busca buscas richiesta cercate cerchi gesucht gesuchte angeforderte gevraagde запрошенная запрашиваемая",
    "<home>": "homepage startseite accueil inicio início startpagina главную",
    "<later>": "later shortly moments minutes soon später plus-tard",
    "<maintenance>": "maintenance wartung wartungsarbeiten mantenimiento manutenção manutenzione onderhoud обслуживание",
    "<down>": "temporarily unavailable down offline vorübergehend indisponible",
    "<deny>": "denied forbidden unauthorized verweigert refusé denegado negado negato geweigerd запрещён запрещен",
    "<entry>": "access permission permissions zugriff accès acceso acesso accesso toegang доступ",
    "<human>": "human robot robots captcha mensch humain humano umano",
    "<prove>": "prove confirm verify verifying checking security bestätigen confirmez confirme confermi",
    "<expired>": "expired timed expiré abgelaufen expirado scaduta verlopen истекла",
    "<sign>": "sign log login signin",
    "<copy>": """text copy content heading headline title subtitle paragraph description caption tagline placeholder footer sidebar intro entry texte titre texto
        título testo titolo tekst titel paragraaf текст заголовок""",
    "<dummy>": """dummy placeholder sample filler platzhaltertext blindtext beispieltext fülltext relleno ejemplo exemplo provisoire remplissage segnaposto esempio
        voorbeeldtekst vultekst opvultekst рыба""",
    "<own>": "your ihr ihren votre su tu seu il tuo vostro uw je ваш",
    "<here>": "here hier ici aquí aqui qui здесь",
    "<insert>": "insert add enter type put write replace change edit inserisci inserire escriba inserte insira digite insérez saisissez plaats vul voeg вставьте введите fill",
    "<swap>": "replace replaced ersetzen remplacer compléter sustituir substituir sostituire vervangen заменить completed supplied",
    "<click>": "click double klicken cliquez clic clique clicca klik",
    "<exception>": "unhandled uncaught traceback exception fatal segfault panic goroutine stacktrace",
    "<bla>": "bla blah",
    "<xxx>": "xxx xxxx",
    "<test>": "test testing",
    "<foo>": "foo bar baz qux",
    "<n/a>": "nslasha tbd tba",
}
# Two words that are one token.
PAIRS = {
    "not found": "<gone>", "not exist": "<gone>", "doesn't exist": "<gone>", "no longer": "<gone>", "nicht gefunden": "<gone>", "nicht mehr": "<gone>", "non esiste": "<gone>",
    "can't be": "<fail>", "cannot be": "<fail>", "not be": "<fail>", "can't find": "<gone>", "couldn't find": "<gone>", "cannot find": "<gone>", "has moved": "<gone>", "have moved": "<gone>", "never existed": "<gone>",
    "try again": "<again>", "went wrong": "<wrong>", "isn't working": "<wrong>", "has occurred": "<wrong>", "unusual traffic": "<traffic>", "core dumped": "<dump>", "segmentation fault": "<dump>",
    "isn't supported": "<outdated>", "not supported": "<outdated>", "not support": "<outdated>", "no longer supported": "<outdated>", "not compatible": "<outdated>", "upgrade to": "<upgrade>",
    "too many": "<many>", "bad gateway": "<reason>", "bad request": "<reason>", "service unavailable": "<reason>", "service temporarily": "<reason>", "gateway timeout": "<reason>", "gateway time": "<reason>",
    "internal server": "<reason>", "internal error": "<reason>", "many requests": "<reason>", "request timeout": "<reason>", "request time": "<reason>", "not allowed": "<reason>", "not implemented": "<reason>",
    "switched off": "<off>", "turned off": "<off>", "without javascript": "<script>", "back home": "<home>", "return home": "<home>", "start page": "<home>", "home page": "<home>",
}
# The same in Chinese, which is written without blanks.
HAN = {
    "启用": "<enable>", "开启": "<enable>", "打开": "<enable>", "禁用": "<off>", "请": "<need>", "浏览器": "<browser>", "页面": "<page>", "网站": "<page>", "网页": "<page>", "未找到": "<gone>",
    "不存在": "<gone>", "无法找到": "<gone>", "返回": "<view>", "刷新": "<view>", "查看": "<view>", "继续": "<view>", "首页": "<home>", "错误": "<error>", "访问": "<entry>", "拒绝": "<deny>", "稍后": "<later>",
    "占位": "<dummy>", "示例": "<dummy>", "文本": "<copy>", "维护": "<maintenance>", "此处": "<here>", "输入": "<insert>",
}

# Exemplars, one a line, of each kind of residue; a leading ! asks for its words in order, next to each other.
EXEMPLARS = {
    "placeholder": """
        {{name}}
        ${name}
        <%= name %>
        {% name %}
        *|NAME|*
        @@name@@
        ~~name~~
        <<name>>
        [[name]]
        ((name))
        [your name]
        [insert name]
        (your name)
        <first_name>
        {company}
        %company%
        #company#
        @company@
        __company__
        $company$
        |company|
        {0}
        {{name
        xxxx
        ____
        ???
        hello undefined
        [object Object]
        #REF!
        todo: add""",
    "script": """
        please enable javascript
        you need to enable javascript to view this page
        enable javascript in your browser
        allow scripts for this page
        enable scripts to load
        javascript is disabled in your browser
        scripts are blocked and the page cannot be displayed
        scripts blocked so not be displayed
        javascript is required to view
        this page requires javascript
        your browser does not support javascript
        enable javascript first and reload
        until you turn javascript on
        content needs javascript turned on
        app javascript enabled
        please enable cookies
        cookies must be enabled to use
        cookies are off, allow cookies
        allow cookies and try again
        allow cookies to continue
        cookies are blocked, enable
        this site requires cookies
        ! unsupported browser
        your browser is not supported
        this site does not support your browser
        upgrade your browser
        please use another supported browser""",
    "filler": """
        ! your text here
        ! your text goes here
        ! text goes here
        ! insert text here
        ! add your text here
        ! type something here
        ! add text
        replace this text with your own
        replace this text later
        click here to edit this text
        click to change text
        this is sample text
        this is placeholder text for layout
        ! dummy text
        text to be replaced later
        placeholder text completed later
        ! sample page
        text will follow later
        text ersetzen beispieltext
        ! bitte ersetzen beispieltext
        ! texte à compléter
        ! texte provisoire
        ! texto de relleno
        ! testo segnaposto
        ! текст рыба
        bla bla bla bla
        test test test test test
        n/a n/a n/a n/a
        xxx xxx xxx xxx
        foo bar foo bar foo""",
    "error": """
        ! <n> not found
        ! <n> bad gateway
        ! <n> forbidden
        ! <n> too many requests
        ! page not found
        ! error <n> page
        ! error <n>
        http error <n>
        error page not found
        page you requested not found
        page you were looking for does not exist
        sorry page does not exist
        page no longer exists, home
        page has moved or never existed
        page can't be found
        page not be displayed, home
        can't find what you were looking for
        requested url not found on this server
        sorry we can't find
        something went wrong, try again
        something went wrong on our side sorry
        sorry something went wrong
        page isn't working contact the site owner
        an unexpected error has occurred
        the server did not answer
        the server took too long to respond
        site can't be reached
        try again in a few minutes
        please try again later
        access denied, no permission
        no permission to access the server
        no permission to view this resource
        unusual traffic from your network
        prove you are not a robot
        verify you are human
        security check to access, human
        captcha to continue
        session expired, sign in again
        session timed out, log in
        request limit reached, slow down
        site is down for maintenance
        scheduled maintenance, check back later
        scheduled maintenance unavailable
        service unavailable, try again
        server internal error request
        request could not be completed""",
    "program": """
        traceback most recent call last
        <exception:>
        <frame> <frame>
        uncaught <exception:>
        segmentation fault core dumped
        panic runtime error
        goroutine running
        warning <path> on line
        notice undefined <path> on line
        fatal error <path>
        fatal error call to undefined function
        error in your sql syntax
        sqlstate connection refused
        error establishing a database connection
        cannot connect to database server socket
        unhandled exception <frame>
        ! npm err
        ! command not found
        <oracode>""",
}
# Words with which a text speaks about such things; alone within the sentence they make a frame.
FRAMES = """explain explains explained describe describes compare compares discuss discusses summarize draft teach teaches teaching lesson tutorial tutorials lecture
course training essay article history difference wording survey says said asks asked story call called term phrase meaning means mean acceptance requirement law regulators
designers developers visitors users visitor developer pupils customers relatives audience why how what whether which if when he she they his her our team example
compares ask tells told politely message notice notices beginner portals python standard manual"""
# Of these, words that notices hold as well: two are needed for a frame.
WEAK_FRAMES = "if when our what how why team message he she they his her visitors users customers which means notice call called manual asked"
# Nouns and verbs that introduce a notation as such.
MENTIONS = """token variable syntax tag notation macro expression literal keyword delimiter directive markup placeholder stands expands resolves evaluates template
templates engine jinja mustache config setting key hashtags"""
# What stands inside a placeholder.
FIELDS = """company role site task id batch reviewer first last full client customer name summary due date contact product city amount deadline occupation invoice no
number subject line address street phone email mail url link title description value price total department team manager author topic country state zip code user
username recipient sender order project position employer text here insert enter add fill in tbd todo your ihr ihre votre su sua il vostro uw job start end time day
month year quantity item location signature greeting party hotel patient opening closing a b goes prénom nom nombre cliente nachname vorname naam achternaam cognome nome"""
# The passage of made-up Latin that fills layouts.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis
nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat
nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"""
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
STATUSES = frozenset("400 401 402 403 404 405 406 407 408 409 410 413 414 418 422 429 500 501 502 503 504 505 511 520 521 522 523 524".split())

_WORD_TOKEN = {w: t for t, ws in CONCEPTS.items() for w in ws.split()}
_FIELDS = frozenset(FIELDS.split())
_FRAMES, _WEAK, _MENTIONS = frozenset(FRAMES.split()), frozenset(WEAK_FRAMES.split()), frozenset(MENTIONS.split())
_LOREM = LOREM.replace(" ", "").replace("\n", "")
_LOREM_WORDS = frozenset(LOREM.split())
# Words of the passage that are also ordinary words of some language; a run of these alone is no filler.
_COMMON = frozenset("dolor sit in ad ex ea id est et ut do non sed eu esse qui sint sunt quis labor".split())
_PAIR_HEADS = frozenset(p.split()[0] for p in PAIRS)
_ELEMENTS = frozenset("title address link time section area data form label input select button".split())
_STOP_WORDS = frozenset("""the a an to of in on at is are was be been we this that it and or so for with by from as has have had some seems i'm we're la le les de
el en un une der die das ist sind wird ist per с в на не du des os""".split())

_NAME = r"[\w .'-]{1,40}"
#: Notations of template languages; the group name is the token of the notation.
_NOTATIONS = {
    "mustache": rf"\{{\{{\s*{_NAME}?\s*\}}\}}", "dollar": rf"\$\{{\s*{_NAME}\s*\}}", "erb": r"<%=?\s*[@\w .]{1,40}\s*%>", "jinja": rf"\{{%\s*{_NAME}\s*%\}}", "merge": rf"\*\|\s*{_NAME}\s*\|\*",
    "ats": rf"@@\s*{_NAME}\s*@@", "tildes": rf"~~\s*{_NAME}\s*~~", "guillemets": rf"<<\s*{_NAME}\s*>>", "wiki": rf"\[\[\s*{_NAME}\s*\]\]", "parens": rf"\(\(\s*{_NAME}\s*\)\)",
    "half": r"\{\{\s*[a-zA-Z]\w*(?: (?:id|no|name|date|line)\b)?(?!.{0,30}\}\})", "object": r"\[object object\]", "cell": r"#(?:REF!|NAME\?|VALUE!|DIV/0!|N/A)", "xs": r"\bX{2}/X{2}/X{4}\b|\bX{4,}\b|\bx{4,}\b",
    "queries": r"(?<![^\s(\"'])\?{3}(?![^\s.,;:)\"'])", "blanks": r"(?<![\w_])_{4,}(?![\w_])", "number": r"\{\d{1,2}\}(?=\s+[a-z]|$)", "todo": r"\btodo: (?:add|insert|fill in|write)\b",
    "unset": r"(?<=[a-z] )undefined\b(?=[ ?.,;]|$)|\bNaN\b(?= [a-z])|(?<=[a-z] )null(?=,)",
    "asked": r"\[(?:insert|enter|fill in|add|tbd|todo|placeholder)\b[^\]\n]{0,40}\]|<(?:insert|enter|fill in|add) [\w ]{1,30}>",
}
_BRACKETED = {
    "square": r"\[(?:\.\.\.)?[\w :]{1,40}(?:\.\.\.)?\]", "angle": r"<b>[\w ]{1,30}\?</b>|</?[\w ]{1,30}>", "brace": r"\{[\w ]{1,30}\}", "paren": r"\((?:your|insert|enter|fill in|add) [\w ]{1,30}(?: here)?\)",
    "hash": r"#[a-z][\w ]{0,30}#", "percent": r"%[a-z][\w ]{0,30}%", "at": r"@[a-z][\w ]{0,30}@", "bar": r"\|[a-z][\w ]{0,30}\|", "dollars": r"\$[a-z][\w ]{0,30}\$", "shell": r"\$[a-z]\w{2,30}\b", "dunder": r"(?<!\w)__[a-z][\w ]{0,30}?__\b",
}
_PROGRAM = {
    "exc": r"\b[A-Z][A-Za-z.]*(?:Error|Exception)\b(?=: \S)|\b(?:[a-z]+\.)+[A-Z]\w*(?:Error|Exception)\b|\b(?:[A-Z]+\.)+[A-Z]+(?:ERROR|EXCEPTION)\b",
    "frame": r"(?:at|AT) [\w$<>]+\.[\w.$<>]+\([^()\n]{0,60}\)", "file": r"File \"[^\"\n]{1,80}\", line \d+", "path": r"(?<!\w)(?:/[\w.-]+){2,}(?::\d+)?|\b[A-Z]:\\[\w.\\-]+", "oracode": r"\b(?:ORA|SQL|DB2)-\d{4,5}\b",
}
_OUTPUTS = {"exc": "<exception:>", "frame": "<frame>", "file": "<frame>", "path": "<path>", "oracode": "<oracode>"}
_CASE_SENSITIVE = ("unset", "xs", "exc", "frame", "file", "path", "oracode")
_COMPILED = {k: re.compile(v, 0 if k in _CASE_SENSITIVE else re.IGNORECASE) for k, v in (_NOTATIONS | _BRACKETED | _PROGRAM).items()}
#: Notations by the character they start with, tried in this order.
_BY_FIRST = {
    "{": ("mustache", "jinja", "number", "half", "brace"), "$": ("dollar", "dollars", "shell"), "<": ("erb", "guillemets", "asked", "angle"), "*": ("merge",), "@": ("ats", "at"), "~": ("tildes",),
    "[": ("wiki", "object", "asked", "square"), "(": ("parens", "paren"), "#": ("cell", "hash"), "%": ("percent",), "|": ("bar",), "_": ("blanks", "dunder"), "?": ("queries",),
}
_FIRST = re.compile(r"[{$<*@~\[(#%|?_]")
#: What else is searched for, and without which strings in the text it need not be.
_ELSEWHERE = (("xs", ("XX", "xxxx")), ("todo", ("todo: ", "TODO: ", "Todo: ")), ("unset", ("undefined", "NaN", "null,")), ("exc", ("Error", "Exception", "ERROR", "EXCEPTION")), ("frame", ("at ", "AT ")), ("file", ('File "',)), ("path", ("/", "\\")), ("oracode", ("ORA-", "SQL", "DB2-")))


def _specials(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the notations and program outputs in a text, first and outermost ones first."""
    out = []
    for m in _FIRST.finditer(text):
        for kind in _BY_FIRST[m.group()[0]]:
            found = _COMPILED[kind].match(text, m.start())
            if found and (token := _special(text, kind, found)):
                out.append((found.start(), found.end(), token))
                break
    for kind, hints in _ELSEWHERE:
        if any(h in text for h in hints):
            out += [(m.start(), m.end(), t) for m in _COMPILED[kind].finditer(text) for t in [_special(text, kind, m)] if t]
    out.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for x in out:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


#: Words, and ends of sentences, which are matched by their marks.
_WORD = re.compile(r"[\w'’]+|[.!?…。！？\n]")
_HAN_RUN = re.compile("[㐀-鿿]+")
_SPLIT_FIELD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BEFORE, _AFTER = "\"'“‘«(:,;–—-/", "\"'”’».,;:!?)–—-/"
_SNAKE = re.compile(r"[^\W\d_]+(?:_[^\W_]+)+")
_CAMEL_NAME = re.compile(r"[a-z]+(?:[A-Z][a-z]+)+")
_CAPITALS = re.compile(r"[A-Z][A-Za-z]+(?: (?:of|and|the|de|du|des|der) (?=[A-Z]))?(?: [A-Z][A-Za-z]*)+")
_ONE_CAPITAL = re.compile(r"[A-Z]{3,}")
_LAST_WORD = re.compile(r"([^\W\d_]+|:)\s*[\"'“‘«(]?$")
# Function words and openings after which a value is due.
_ASKING = frozenset("""the a an to for from of by at on in with and or dear hello hi as per via before after until between than around under der die das dem den
ein eine einen an für von mit bei bis und ist le la les un une du de des à au aux pour par avec et el los las del al en para por con y il lo gli di
da per e o os as do com em het een van voor met naar have lists mention""".split())
_BE = frozenset("is are was were ist sind est sont es son".split())


def _is_field(slot: str) -> bool:
    words = [w.lower() for w in _SPLIT_FIELD.findall(_CAMEL.sub(" ", slot))]
    if len(words) == 1 and words[0] not in _FIELDS and any(words[0][:k] in _FIELDS and words[0][k:] in _FIELDS for k in range(2, len(words[0]) - 1)):
        return True
    return bool(words) and all(w in _FIELDS for w in words) and (len(words) > 1 or words[0] not in ("in", "no", "id", "il", "su", "here", "end", "day", "i", "a", "b"))


def _asked_for(text: str, start: int) -> bool:
    before = _LAST_WORD.search(text[max(0, start - 40) : start])
    return bool(before) and (before[1] == ":" or before[1].lower() in _ASKING)


def _stands_for_value(text: str, start: int, end: int) -> bool:
    """Whether a bracketed slot, whatever its words, has the form of a field name and stands where a value belongs.

    Snake case, camel case and several capitalised words are names by form; one word in capitals also needs a word
    before it that asks for a value. Cells between bars, shell variables and elements that are closed are none.
    """
    slot = text[start:end]
    if slot[0] in "|(" or slot[0] == "$" != slot[-1] or slot.startswith(("</", "<b>")) or (slot[0] == "<" and f"</{slot[1:]}" in text):
        return False
    if (start and not (text[start - 1].isspace() or text[start - 1] in _BEFORE)) or (end < len(text) and not (text[end].isspace() or text[end] in _AFTER)):
        return False
    name = slot[2:-2] if slot.startswith("__") else slot[1:-1]
    name = name.strip(" .")
    if _SNAKE.fullmatch(name) or _CAMEL_NAME.fullmatch(name) or _CAPITALS.fullmatch(name):
        return True
    return bool(_ONE_CAPITAL.fullmatch(name)) and _asked_for(text, start)


def _special(text: str, kind: str, m: re.Match) -> str | None:
    """Token of a match of a notation; None where it is no notation after all."""
    slot = m.group()
    if kind in _OUTPUTS:
        return None if kind == "frame" and m.start() and text[m.start() - 1].isalnum() else _OUTPUTS[kind]
    if kind == "unset":
        last = _LAST_WORD.search(text[max(0, m.start() - 40) : m.start()])
        return None if not last or last[1].lower() not in _ASKING or last[1].lower() in _BE else f"<{kind}>"
    if kind in _BRACKETED:
        if slot.lower().strip("</>") in _ELEMENTS or not (_is_field(slot) or _stands_for_value(text, m.start(), m.end())):
            return None
    return f"<{kind}>"


def _is_mash(word: str) -> bool:
    """Keys struck one beside the other on one row, in runs of at least three."""
    return len(word) > 2 and any(
        all(c in row for c in word) and all(abs(row.index(a) - row.index(b)) in (1, 2) for a, b in zip(word, word[1:])) for row in KEY_ROWS
    )


def _is_lorem(word: str) -> bool:
    """A word of the passage, or four letters and more of it run together, but for one or two at the end."""
    return word in _LOREM_WORDS or any(len(word) - k > 3 and word[: len(word) - k] in _LOREM for k in range(3))


def _own_tokens(w: str) -> tuple[str, ...]:
    """Tokens of a word by itself: none for most words."""
    t = _WORD_TOKEN.get(w)
    if t:
        return (t,)
    if w in STATUSES:
        return ("<n>",)
    if w in _PLAIN or w in _FRAMES or w in _MENTIONS:
        return (w,)
    if _is_lorem(w):
        return ("<lorem>" if w not in _COMMON else "<latin>",)
    if _is_mash(w):
        return ("<mash>",)
    if w > "㐀" and _HAN_RUN.search(w):
        return (*(c for k, c in HAN.items() if k in w), *(("<script>",) if "javascript" in w or "js" in w else ()))
    return ()


_HEAD = "\0"


class _Tokens(dict):
    """Tokens of each word met, with ``_HEAD`` before those of a word that may begin a pair; bounded."""

    KEPT = 200_000

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > self.KEPT:
            self.clear()
        w = raw.strip("'’_")
        out = _own_tokens(w) if w and w[0].isalnum() else (".",) if raw in ".!?…。！？\n" else ()
        out = self[raw] = (_HEAD, *out) if w in _PAIR_HEADS else out
        return out


_TOKENS = _Tokens()


def _add_words(part: str, at: int, toks: list[str], poss: list[int]) -> int:
    """Append the tokens of a piece without notations; returns the next position. Ends of sentences take none."""
    part = part.lower()
    words = _WORD.findall(part.replace("n/a", " nslasha ") if "n/a" in part else part)
    skip, marks = -1, 0
    for i, found in enumerate(map(_TOKENS.__getitem__, words)):
        if not found or i == skip:
            continue
        place = at + i - marks
        if found[0] == ".":
            toks.append(".")
            poss.append(place)
            marks += 1
            continue
        if found[0] == _HEAD:
            pair = PAIRS.get(f"{words[i]} {words[i + 1]}") if i + 1 < len(words) else None
            if pair:
                skip = i + 1
            found = (pair,) if pair else found[1:]
        for t in found:
            toks.append(t)
            poss.append(place)
    return at + len(words) - marks


def postings(text: str) -> tuple[list[str], list[int]]:
    """(tokens, positions) of the exemplar tokens of a text; "." marks the ends of sentences."""
    toks: list[str] = []
    poss: list[int] = []
    at = done = 0
    for start, end, t in _specials(text):
        at = _add_words(text[done:start], at, toks, poss)
        toks.append(t)
        poss.append(at)
        at += 1
        done = end
    at = _add_words(text[done:], at, toks, poss)
    toks.append(".")
    poss.append(at)
    return toks, poss


def _exemplar_tokens(line: str) -> list[str]:
    if line.startswith("<") and line.endswith(":>"):
        return ["<exception:>"]
    out: list[str] = []
    for piece in re.split(r"(<(?:n|frame|path|oracode|exception:)>)", line):
        if piece.startswith("<") and piece.endswith(">") and piece[1:-1] in ("n", "frame", "path", "oracode", "exception:"):
            out.append(piece)
        elif piece:
            found = [t for _, _, t in _specials(piece)]
            if found:
                out += found
                continue
            words, toks, skip = [w for w in _WORD.findall(piece.lower().replace("n/a", "nslasha")) if w[0].isalnum()], [], -1
            for i, w in enumerate(words):
                if i == skip:
                    continue
                pair = PAIRS.get(f"{w} {words[i + 1]}") if i + 1 < len(words) else None
                if pair:
                    skip = i + 1
                t = pair or _WORD_TOKEN.get(w) or ("<n>" if w in STATUSES else w)
                if t not in _STOP_WORDS:
                    toks.append(t)
            out += toks
    return out


def _exemplars() -> list[tuple[str, list[str], bool]]:
    """(label, tokens, tight) of every exemplar; tight ones ask for their tokens in order, next to each other."""
    out = []
    for label, lines in EXEMPLARS.items():
        for line in lines.strip().splitlines():
            line = line.strip()
            tight = line.startswith("! ")
            out.append((label, _exemplar_tokens(line.removeprefix("! ")), tight))
    return out


def exemplars() -> list[tuple[str, list[str]]]:
    """(label, tokens) of every exemplar."""
    return [(label, toks) for label, toks, _ in _exemplars()]


_PLAIN = frozenset()
_PLAIN = frozenset(t for _, toks in exemplars() for t in toks if t[0] != "<")
VOCABULARY = sorted({t for _, toks in exemplars() for t in toks} | set(CONCEPTS) | set(PAIRS.values()) | {"<lorem>", "<latin>", "<mash>", ".", "<n>"} | _FRAMES | _MENTIONS)
_CODE = {t: i for i, t in enumerate(VOCABULARY)}


class Index:
    """Inverted index of the exemplars under document frequencies of their tokens."""

    def __init__(self, frequencies: dict[str, int], documents: int):
        self.weight = {t: 1.0 + math.log((documents + 1) / (frequencies.get(t, 0) + 1)) for t in VOCABULARY}
        self.unknown = 1.0 + math.log(documents + 1) / 2
        self.exemplars, self.by_token = [], {}
        for k, (label, toks, tight) in enumerate(_exemplars()):
            distinct: dict[str, int] = {}
            for t in toks:
                distinct[t] = distinct.get(t, 0) + 1
            total = sum(self.weight[t] * n for t, n in distinct.items())
            width = len(toks) + 1 if tight else 2 * len(toks) + 6 if len(toks) > 1 else 1
            self.exemplars.append((label, distinct, total, width, len(toks), toks if tight else None))
            for t in sorted(distinct, key=lambda t: -self.weight[t] * distinct[t])[: 1 if len(toks) < 4 else 2]:
                self.by_token.setdefault(t, []).append(k)

    def _windows(self, k: int, places: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
        """Spans of positions that contain enough of exemplar k's weight, and all but one token of a long one."""
        _, distinct, total, width, size, order = self.exemplars[k]
        if order:
            for p in places.get(order[0], ()):
                at = p
                for t in order[1:]:
                    at = next((q for q in places.get(t, ()) if at <= q < p + width), None)
                    if at is None:
                        break
                if at is not None:
                    yield p, at
            return
        marks = sorted((p, t) for t in distinct for p in places.get(t, ()))
        lo, held, weight, have = 0, {}, 0.0, 0
        for p, t in marks:
            held[t] = held.get(t, 0) + 1
            if held[t] <= distinct[t]:
                weight += self.weight[t]
                have += 1
            while p - marks[lo][0] >= width:
                u = marks[lo][1]
                if held[u] <= distinct[u]:
                    weight -= self.weight[u]
                    have -= 1
                held[u] -= 1
                lo += 1
            if have >= size - (size > 3) and weight >= COVERAGE * total - 1e-9:
                yield marks[lo][0], p

    def _filler(self, toks: list[str], poss: list[int], end: int) -> bool:
        """Whether some window's weight lies in struck keys or made-up Latin."""
        own = [(p, t) for t, p in zip(toks, poss) if t in ("<lorem>", "<latin>", "<mash>")]
        if sum(t != "<latin>" for _, t in own) < 3:
            return False
        at = [p for p, _ in own]
        other = {p: self.weight[t] for t, p in zip(toks, poss) if t not in ("<lorem>", "<latin>", "<mash>", ".")}
        for i, p in enumerate(at):
            run = min(FILLER_RUN, end)
            if p + run > end and end >= FILLER_RUN:
                break
            inside = own[i : bisect_right(at, p + run - 1)]
            if sum(t != "<latin>" for _, t in inside) < 3:
                continue
            mine = sum(self.weight[t] for _, t in inside)
            rest = sum(other.get(q, self.unknown) for q in range(p, min(p + run, end))) - sum(other.get(q, self.unknown) for q, _ in inside)
            if len(inside) >= FILLER_SHARE * run and mine >= FILLER_SHARE * (mine + 0.5 * rest):
                return True
        return False

    def classify_postings(self, toks: list[str], poss: list[int]) -> str | None:
        """Label of the first residue in posting lists, or None."""
        places: dict[str, list[int]] = {}
        for t, p in zip(toks, poss):
            places.setdefault(t, []).append(p)
        stops = places.get(".", [0])
        framing: list[tuple[int, str]] | None = None
        for k in sorted({k for t in places for k in self.by_token.get(t, ())}):
            label = self.exemplars[k][0]
            for lo, hi in self._windows(k, places):
                if framing is None:
                    framing = [(p, t) for t, p in zip(toks, poss) if t in _FRAMES or t in _MENTIONS]
                first, last = bisect_right(stops, lo) - 1, bisect_right(stops, hi)
                start, end = stops[first] if first >= 0 else 0, stops[last] if last < len(stops) else hi + 1
                if label == "placeholder":
                    if not any(t in _MENTIONS and lo - NEAR_MENTION <= p <= hi + NEAR_MENTION and start <= p < end for p, t in framing):
                        return label
                    continue
                near = {t for p, t in framing if max(start, lo - NEAR_FRAME) <= p < min(end, hi + NEAR_FRAME) and t in _FRAMES and t not in self.exemplars[k][1]}
                if len(near) < 2 and not near - _WEAK:
                    return "error" if label == "program" else label
        return "filler" if self._filler(toks, poss, poss[-1] if poss else 0) else None

    def classify(self, text: str) -> str | None:
        """Label of the first residue in a text, or None."""
        return self.classify_postings(*postings(consistent_form(text)))


def residue_documents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind) of each document to be excluded."""
    schema = "id bigint, toks array<int>, poss array<int>, n bigint"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = [0] * len(VOCABULARY), 0
        for batch in batches:
            ids, toks, poss = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += 1
                found, at = postings(consistent_form(text))
                codes = [_CODE[t] for t in found]
                for c in {*codes}:
                    seen[c] += 1
                if len(found) > 1:
                    ids.append(i)
                    toks.append(codes)
                    poss.append(at)
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "toks": pa.array(toks, pa.list_(pa.int32())), "poss": pa.array(poss, pa.list_(pa.int32())), "n": pa.array([0] * len(ids), pa.int64())})
        # The counts of this task: one row, as long as the vocabulary.
        yield pa.record_batch({"id": pa.array([None], pa.int64()), "toks": pa.array([list(range(len(seen)))], pa.list_(pa.int32())), "poss": pa.array([seen], pa.list_(pa.int32())), "n": pa.array([n], pa.int64())})

    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    posted = materialize(texts.mapInArrow(post, schema), "postings")
    counted = posted.where("id is null")
    # One row per exemplar token: as large as the exemplars, whatever the corpus.
    per_token = counted.select(F.explode(F.arrays_zip("toks", "poss")).alias("c")).groupBy("c.toks").agg(F.sum("c.poss").alias("n")).collect()
    frequencies = {VOCABULARY[r[0]]: r[1] for r in per_token}
    total = counted.agg(F.sum("n")).first()[0] or 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequencies, total)
        for batch in batches:
            ids, kinds = [], []
            for i, toks, poss in zip(*(batch.column(c).to_pylist() for c in range(3))):
                kind = index.classify_postings([VOCABULARY[c] for c in toks], poss)
                if kind:
                    ids.append(i)
                    kinds.append(kind)
            yield pa.record_batch({id_col: pa.array(ids, pa.int64()), "kind": pa.array(kinds, pa.string())})

    found = posted.where("id is not null").select("id", "toks", "poss").mapInArrow(find, f"{id_col} bigint, kind string")
    return found.groupBy(id_col).agg(F.min("kind").alias("kind"))
