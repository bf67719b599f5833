"""Person name and role column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailscope.functions.text import fold
from retailscope.functions.urls import domain_key

# Letters of names, and how names are written.
# nested, so that a letter is compared with the common ranges first and not with every letter of the list
_UP, _LOW = "[A-Z[ĄĆĘŁŃÓŚŹŻ]]", "[a-z[ąćęłńóśźż]]"
_WORDING = "[a-z[A-Z[\\s[-ĄĆĘŁŃÓŚŹŻąćęłńóśźż]]]]"
NAME_TOKEN = f"{_UP}{_LOW}{{1,20}}(?:-{_UP}{_LOW}{{1,20}})?"
FULL_NAME = f"{NAME_TOKEN}(?:\\s+{NAME_TOKEN}){{1,2}}"
# Role wording, most senior first.
_TAIL = "[\\p{L}]*"
ROLE_WORDING = {
    "CEO": f"ceo|chief executive officer|prezes(?:\\s+zarz[aą]du)?|dyrektor\\s+generaln{_TAIL}",
    "Founder": f"founder|za[lł]o[zż]yciel{_TAIL}",
    "Owner": f"owner|proprietor|w[lł]a[sś]ciciel{_TAIL}",
    "Co-Founder": f"co-?founder|wsp[oó][lł]za[lł]o[zż]yciel{_TAIL}",
    "Head of Ecommerce": "head\\s+of\\s+e-?commerce|dyrektor\\s+e-?commerce|kierownik\\s+e-?commerce",
    "CTO": f"cto|chief technology officer|dyrektor\\s+techniczn{_TAIL}",
    "Ecommerce Manager": "e-?commerce\\s+manager|mene?[dż]?[zż]er\\s+e-?commerce|manager\\s+sklepu",
    "Other": f"dyrektor{_TAIL}|kierownik{_TAIL}|mene?[dż]?[zż]er{_TAIL}|manager",
}
# How a text introduces a person.
INTRODUCTION = (
    "(?:prowadzi|za[lł]o[zż]y[lł]\\w*(?:\\s+przez)?|stworzy[lł]\\w*|za\\s+sklepem\\s+stoi|"
    f"founded\\s+by|started\\s+by|run\\s+by|created\\s+by|owned\\s+by)\\s+({FULL_NAME})"
)
NAME_THEN_ROLE = f"({FULL_NAME})\\s*[,\\-–—|(]\\s*({_WORDING}{{3,40}})"
# the lookahead says only what must follow of the rest, once: letters and blanks up to the first dash or colon
ROLE_THEN_NAME = f"(?=[a-z[A-Z[\\s[ĄĆĘŁŃÓŚŹŻąćęłńóśźż]]]]{{0,40}}+\\s*+[:\\-–—])({_WORDING}{{3,40}})\\s*[:\\-–—]\\s*({FULL_NAME})"
# What each text with a match of the pattern above holds.
BEFORE_NAME = f"[:\\-–—]\\s*{FULL_NAME}"
# Capitalised words of shop pages that are no names.
NAME_STOPWORDS = (
    "polityka prywatności prywatnosci prywatność regulamin regulaminu sklep sklepu sklepie dostawa dostawy zwroty zwrot "
    "reklamacje reklamacja kontakt warunki ochrona danych osobowych dane osobowe nasz nasza nasze firma firmy adres "
    "godziny otwarcia zamówienia płatności wysyłka koszyk konto strona główna kodeks cywilny ustawa ustawy klient klienta "
    "sprzedawca sprzedawcy kupujący konsument rzeczypospolitej polskiej polska unii europejskiej spółka spolka oddział "
    "urząd urzędu urzedu prezes prezesa inspektor inspektora administrator administratorem privacy policy terms service "
    "shipping returns refund contact about our team store shop cart account home cookie cookies rights reserved customer "
    "support company limited newsletter data protection office officer president personal authority controller department"
).split()
# A capitalised name right before a role, with or without a comma.
ATTRIBUTION = "(?u)(\\p{Lu}[\\p{L}'’-]+)(?:\\s+(\\p{Lu}[\\p{L}'’-]+))?(\\s*,)?\\s*$"


def role_pattern(role: str) -> str:
    return f"(?iu)(?<![\\p{{L}}])(?:{ROLE_WORDING[role]})(?![\\p{{L}}])"


def detect_role(text: Column) -> Column:
    """The most senior role named in a text and its wording, or null."""
    return F.coalesce(
        *[
            F.when(
                text.rlike(role_pattern(role)),
                F.struct(F.lit(role).alias("role"), F.trim(F.regexp_extract(text, role_pattern(role), 0)).alias("matched")),
            )
            for role in ROLE_WORDING
        ]
    )


def name_key(c: Column) -> Column:
    """A folded name: letters a–z, one blank between words."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z]+", " "))


def mailbox_key(email: Column) -> Column:
    """The local part of an address in the form of a name key."""
    local = F.split_part(F.regexp_extract(email, "(?s)^(.*?)(?:@[^@]*)?$", 1), F.lit("+"), F.lit(1))
    return F.trim(F.regexp_replace(F.lower(local), "[^a-z]+", " "))


def long_parts(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda p: F.length(p) > 1)


def looks_like_person_name(c: Column, store_domain: Column | None = None) -> Column:
    """Two or three words that are names, and not the shop's own."""
    tokens = F.split(F.trim(c), "\\s+")
    words = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "[^\\p{L}-]", "")))
    stops = lambda w: w.isin(*NAME_STOPWORDS)
    # bound in a lambda, so that the words are taken once
    good = F.exists(
        F.array(words),
        lambda ws: F.size(ws).between(2, 3)
        & F.forall(ws, lambda w: F.length(w) >= 2)
        & ~F.exists(ws, lambda w: stops(w) | F.exists(F.split(w, "-"), stops)),
    )
    if store_domain is not None:
        label = F.split_part(F.coalesce(domain_key(store_domain), F.lit("")), F.lit("."), F.lit(1))
        collapsed = F.regexp_replace(F.lower(c), "[^a-z]", "")
        own = F.exists(F.array(label), lambda l: (F.length(l) > 3) & (collapsed == F.regexp_replace(l, "[^a-z]", "")))
        good = good & ~own
    return F.coalesce(good, F.lit(False))
