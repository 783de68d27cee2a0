"""Labelled pages for the line labeller: a hand-written reading of page layout in five languages.

No page of the crawl comes with labels. These patterns say which lines of a *training* page are furniture; the model
learns shape, place, neighbours and words from them and is what runs on the crawl. Nothing outside training uses them.
"""

from __future__ import annotations

import re

CONTENT, FURNITURE, SIDEBAR = 0, 1, 2

#: Menu entries, language by language. Fixed values.
MENU = {
    "home", "help", "news", "guides", "shop", "contact", "about us", "forum", "gallery", "sign in", "archive", "events calendar", "search", "login",
    "startseite", "hilfe", "nachrichten", "ratgeber", "laden", "kontakt", "über uns", "bilder", "anmelden", "archiv", "termine",
    "accueil", "aide", "actualités", "boutique", "à propos", "galerie", "connexion", "archives", "agenda",
    "inicio", "ayuda", "noticias", "guías", "tienda", "contacto", "quiénes somos", "foro", "galería", "entrar", "archivo",
    "início", "ajuda", "notícias", "guias", "loja", "sobre nós", "fórum", "galeria", "arquivo",
}

#: Furniture of pages in general, put into training pages at their head or foot. Fixed values; every second one is kept for
#: the test on furniture never seen.
COMMON = [
    "Skip to main content", "Skip to navigation", "Site map", "Back to top", "Print this page", "Accessibility", "Careers", "Advertise with us",
    "Log in or register", "Subscribe to our newsletter", "Follow us on social media", "Read more", "Load more comments", "Contact the newsroom",
    "Manage your preferences", "Do not sell my data", "Powered by our readers", "Menu", "Close menu", "Previous article", "Next article",
    "Leave a reply", "Your e-mail address will not be published", "Terms and conditions", "Cookie settings", "RSS feed", "Download our app",
    "Zum Inhalt springen", "Nach oben", "Seite drucken", "Barrierefreiheit", "Jetzt abonnieren", "Datenschutz", "Cookie-Einstellungen", "Mehr lesen",
    "Folgen Sie uns", "Registrieren", "Vorheriger Artikel", "Nächster Artikel", "Kommentar schreiben", "Inhaltsverzeichnis der Seite",
    "Aller au contenu", "Haut de page", "Imprimer la page", "Accessibilité", "S'abonner à la lettre", "Données personnelles", "Gérer les cookies",
    "Lire la suite", "Suivez-nous", "Créer un compte", "Article précédent", "Article suivant", "Laisser un commentaire", "Plan du site",
    "Saltar al contenido", "Volver arriba", "Imprimir página", "Accesibilidad", "Suscríbete", "Política de privacidad", "Configurar cookies",
    "Leer más", "Síguenos", "Crear cuenta", "Artículo anterior", "Artículo siguiente", "Deja un comentario", "Mapa del sitio",
    "Saltar para o conteúdo", "Voltar ao topo", "Imprimir a página", "Acessibilidade", "Assine já", "Política de privacidade", "Definições de cookies",
    "Ler mais", "Siga-nos", "Criar conta", "Artigo anterior", "Artigo seguinte", "Deixe um comentário", "Mapa do site",
]


def dressed(text: str, labels: list[int], strings: list[str], rng) -> tuple[str, list[int]]:
    """A page with a few of the strings before and after it, and its labels."""
    pick = lambda n: [strings[i] for i in rng.integers(0, len(strings), n)]
    top, foot = pick(int(rng.integers(0, 5))), pick(int(rng.integers(0, 6)))
    if rng.random() < 0.2:
        top = [" | ".join(top)] if top else top
    return "\n".join([*top, text, *foot]), [FURNITURE] * len(top) + labels + [FURNITURE] * len(foot)


#: Openings of sidebars.
SIDEBAR_HEADING = re.compile(
    r"^(most read|more stories|you may also like|more from .+|latest from .+|related( stories| articles)?|"
    r"meistgelesen|das könnte sie auch interessieren|neues von .+|mehr von .+|"
    r"les plus lus|à lire aussi|dernières nouvelles de .+|"
    r"lo más leído|también te puede interesar|lo último de .+|últimas de .+|más de .+|"
    r"mais lidas|também lhe pode interessar|mais de .+)[.!:]?$",
    re.I,
)

#: Whole lines of furniture.
LINE = re.compile(
    r"cookie|©|^copyright \d{4}|all rights reserved|no part of .+ may be reproduced|terms of use|privacy policy|your privacy matters|"
    r"for general information only|^(never miss a story|sign up for|enter your e-?mail)|^(share|tell others|did you like)\b.{0,60}$|"
    r"^(written by our|reported by the|from the editors of|by the .{2,40} desk)|^updated \d+|^posted on|^reading time|^\d+ comments?\b|\d+ (views|comments|times viewed)$|^filed under|"
    r"this (page|article|post|text) (was|has been|is|comes|moved|first)|(earlier|previous) version of this|^(correction|note|editor's note)\b:?|our old address|printed version|print edition|"
    r"alle rechte vorbehalten|nur mit schriftlicher genehmigung|nutzungsbedingungen|impressum|allgemeinen information|wochenbrief|keine geschichte verpassen|geben sie ihre e-mail|"
    r"^diese seite (weiter|wurde|ist|kommt|stammt|zieht)|hat ihnen der beitrag|^(ein bericht unserer|aus der abendausgabe|von der redaktion)|^teilen\b|^aktualisiert vor|^lesezeit|^\d+ kommentare|abgelegt unter|^(korrektur|hinweis)\b|alten adresse|"
    r"tous droits réservés|conditions d'utilisation|mentions légales|titre d'information|lettre hebdomadaire|ne manquez aucun|entrez votre adresse|^partage[rz]|cet article vous a plu|"
    r"^(un reportage de notre|texte : le bureau|par la rédaction)|^mis à jour|^temps de lecture|^\d+ commentaires|^(classé|publié) |^(correction|note) ?:|ancienne adresse|^cette page (vient|a été|provient)|"
    r"todos los derechos|condiciones de uso|aviso legal|solo informativo|boletín semanal|no te pierdas|escribe tu correo|^compart(e|ir)\b.{0,50}$|te ha gustado|¿te gustó|"
    r"^(un reportaje de nuestro|texto: la mesa|por la redacción)|^actualizado h|^tiempo de lectura|^\d+ comentarios|^(archivado|publicado) |^(corrección|nota) ?:|antigua dirección|^esta página (viene|fue|ha)|"
    r"todos os direitos|termos de uso|apenas informativo|boletim semanal|não perca nenhuma|escreva o seu e-mail|^partilh(e|ar)\b.{0,50}$|gostou do artigo|"
    r"^(uma reportagem da nossa|texto: a mesa|pela redação)|^tempo de leitura|^atualizado há|^\d+ comentários|^(arquivado|publicado) |^(correção|nota) ?:|antigo endereço|^esta página (vem|foi)",
    re.I,
)
FILED = re.compile(r"^(filed under|tags?|abgelegt unter|schlagw\w+|classé dans|mots-clés|archivado en|etiquetas|arquivado em|etiquetas)\b", re.I)
_SPLIT = re.compile(r"\s*[/|>»·›•]\s*")
_WORD = re.compile(r"[^\W\d_]+")
_TITLE = re.compile(r"^.{2,60}( – | - |: | — ).{2,60}$")


def _menu(line: str) -> bool:
    low = line.lower().strip(" .")
    if low in MENU:
        return True
    parts = [p for p in _SPLIT.split(low) if p]
    if len(parts) > 1 and parts[0] in MENU and len(line) < 160:
        return True
    rest, hits = f" {low} ", 0
    for m in sorted(MENU, key=len, reverse=True):
        if f" {m} " in rest:
            rest, hits = rest.replace(f" {m} ", "  "), hits + 1
    return hits >= 3 and not rest.strip(" /|>»·›•.,-")


def notice(line: str) -> bool:
    """A long line is a notice if every sentence, or all but one, speaks of rights, cookies, terms or the page."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", line) if p]
    return sum(LINE.search(p) is not None for p in parts) >= max(1, len(parts) - 1)


def label(lines: list[str]) -> list[int]:
    """A label for each line; blank lines get the label of furniture and do not count."""
    out, side = [], False
    for raw in lines:
        x = re.sub(r"\s+", " ", raw).strip()
        if not x:
            out.append(FURNITURE)
            continue
        if SIDEBAR_HEADING.match(x):
            side = True
            out.append(SIDEBAR)
            continue
        n = len(_WORD.findall(x))
        if _menu(x) or LINE.search(x) and (len(x) < 190 or notice(x)) or FILED.match(x) and n <= 6:
            side = False
            out.append(FURNITURE)
        elif side and n <= 12 and not re.search(r"[.!?…]$", x) and not re.match(r"^[•*\-–] |^\d", x) and (_TITLE.match(x) or ", " in x or n <= 9):
            out.append(SIDEBAR)
        else:
            side = False
            out.append(CONTENT)
    return out


#: Words of selling, for labels only. Fixed values.
SALE_PHRASES = [
    # English
    "original", "online", "near me", "free delivery", "wholesale", "best price", "buy", "discount", "sale", "order now", "top quality",
    "cheap", "deal", "deals", "outlet", "free shipping", "low price", "buy now", "shop now", "coupon", "clearance", "bargain",
    # German
    "kaufen", "billig", "günstig", "angebot", "rabatt", "schnäppchen", "versandkostenfrei", "bester preis", "jetzt bestellen",
    "großhandel", "qualität", "im netz", "ausverkauf", "gutschein", "bestellen", "sonderangebot",
    # French
    "acheter", "pas cher", "promo", "remise", "soldes", "commander", "livraison gratuite", "meilleur prix", "en ligne", "qualité",
    "grossiste", "boutique en ligne", "bon plan",
    # Spanish
    "comprar", "barato", "oferta", "descuento", "rebajas", "en línea", "envío gratis", "mejor precio", "pedir ahora", "mayorista",
    "calidad", "cerca de mí", "cupón",
    # Portuguese
    "desconto", "promoção", "saldos", "em linha", "portes grátis", "melhor preço", "encomendar já", "grossista", "qualidade", "perto de mim",
]

#: Wares, for labels only. Fixed values.
PRODUCT_PHRASES = [
    # English
    "loan offer", "winter jacket", "garden lamp", "boots", "desk chair", "printer ink", "phone case", "mattress", "sofa cover",
    "vitamin drops", "wrist watch", "sandals", "bicycle helmet", "car tyres", "sku",
    # German
    "kredit", "winterjacke", "gartenlampe", "stiefel", "bürostuhl", "druckerpatrone", "handyhülle", "matratze", "sofabezug",
    "vitamintropfen", "armbanduhr", "sandalen", "fahrradhelm", "autoreifen",
    # French
    "crédit rapide", "veste d'hiver", "lampe de jardin", "bottes", "chaise de bureau", "cartouche d'encre", "coque de téléphone",
    "matelas", "housse de canapé", "vitamines", "montre", "sandales", "casque vélo", "pneus",
    # Spanish
    "préstamo", "chaqueta de invierno", "lámpara de jardín", "botas", "silla de oficina", "tinta de impresora", "funda de móvil",
    "colchón", "funda de sofá", "vitaminas", "reloj", "sandalias", "casco de bici", "neumáticos",
    # Portuguese
    "empréstimo", "casaco de inverno", "candeeiro de jardim", "cadeira de escritório", "tinteiro", "capa de telemóvel", "colchão",
    "capa de sofá", "relógio", "sandálias", "capacete",
]

_FUNCTION = _SALE = None


def not_prose(text: str) -> bool:
    """Training label of problem 5: more than half of the content is lists, tables, junk, links or keywords."""
    global _FUNCTION, _SALE
    if _FUNCTION is None:
        from tamarack.llm.words import FUNCTION_WORDS

        _SALE = re.compile(r"\b(?:" + "|".join(map(re.escape, SALE_PHRASES + PRODUCT_PHRASES)) + r")\b", re.I)
        _FUNCTION = {w for v in FUNCTION_WORDS.values() for w in v}
    lines = text.split("\n")
    prose = rest = 0
    for x, kind in zip(lines, label(lines)):
        if kind != CONTENT:
            continue
        w = re.findall(r"[^\W\d_]+", x.lower())
        size = len(re.sub(r"\s", "", x))
        listed = re.match(r"\s*([•*\-–—#>]|\d)", x) is not None
        junk = re.search(r"https?://|www\.|#\w+ #|<\w+>|\t|    |\bSKU-|\w\.(example|test|invalid)\b|[{}]| \| .* \| ", x) is not None
        junk |= sum(map(len, w)) < 0.6 * size or sum(len(m) for m in _SALE.findall(x)) > 0.25 * size
        share = sum(t in _FUNCTION for t in w) / max(len(w), 1)
        if share >= 0.17 and len(w) >= (8 if listed else 6) and not junk:
            prose += size
        else:
            rest += size
    return rest > prose and rest > 0
