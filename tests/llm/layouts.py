"""Pages written by hand, in layouts and with names that the generator of training pages does not have.

Each is (html, texts of the article in order). ``P`` are paragraphs of ordinary prose in several languages.
"""

P = {
    "en": ["The council voted on Tuesday to close the old bridge for repairs, and drivers will have to take the northern road until spring.",
           "Engineers found cracks in two of the main pillars last autumn, but the money for the work was only agreed this week.",
           "Shopkeepers on the east bank fear that customers will stay away, although a ferry is meant to run every half hour.",
           "A spokesman said the work should be finished by the end of March, if the winter is not too hard."],
    "de": ["Der Stadtrat hat am Dienstag beschlossen, die alte Brücke wegen Bauarbeiten zu sperren, und der Verkehr wird bis zum Frühjahr umgeleitet.",
           "Fachleute hatten im Herbst Risse in zwei Pfeilern gefunden, doch das Geld wurde erst in dieser Woche bewilligt.",
           "Die Händler am Ostufer fürchten, dass die Kunden ausbleiben, obwohl eine Fähre alle halbe Stunde fahren soll.",
           "Ein Sprecher sagte, die Arbeiten sollten Ende März fertig sein, sofern der Winter nicht zu streng wird."],
    "fr": ["Le conseil a voté mardi la fermeture du vieux pont pour des travaux, et les voitures devront passer par la route du nord jusqu'au printemps.",
           "Les ingénieurs avaient trouvé des fissures dans deux piliers l'automne dernier, mais l'argent n'a été accordé que cette semaine.",
           "Les commerçants de la rive est craignent de perdre des clients, même si un bac doit passer toutes les demi-heures.",
           "Selon un porte-parole, les travaux devraient finir à la fin du mois de mars, si l'hiver n'est pas trop rude."],
    "es": ["El ayuntamiento votó el martes cerrar el puente viejo por obras, y los coches tendrán que ir por la carretera del norte hasta la primavera.",
           "Los ingenieros encontraron grietas en dos pilares el otoño pasado, pero el dinero solo se aprobó esta semana.",
           "Los comerciantes de la orilla este temen perder clientes, aunque habrá un barco cada media hora.",
           "Un portavoz dijo que las obras deberían terminar a finales de marzo, si el invierno no es demasiado duro."],
}
TITLE = {"en": "Old bridge to close until spring", "de": "Alte Brücke bleibt bis zum Frühjahr gesperrt", "fr": "Le vieux pont fermé jusqu'au printemps", "es": "El puente viejo cierra hasta la primavera"}
_MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("News", "Sport", "Weather", "Culture", "Travel"))
_LINKS = "".join(f'<a href="/{i}">{x}</a> ' for i, x in enumerate(("Imprint", "Data protection", "Jobs", "Press")))
_ADS = "Save forty percent on garden chairs today only!"
_COPY = "© 2024 Harbour Media Ltd. All rights reserved."
_TALK = [("anna_k", "I drive over that bridge every day, this will be awful."), ("tom77", "Finally! It should have been done years ago."), ("riverside", "The ferry never runs on time anyway.")]


def _ps(lang: str, tag: str = "p") -> str:
    return "".join(f"<{tag}>{x}</{tag}>" for x in P[lang])


def pages() -> list[tuple[str, list[str]]]:
    out = []
    for lang in P:
        ps, title = P[lang], TITLE[lang]
        whole = [title, *ps]
        add = lambda html, want=whole: out.append((f"<!doctype html><html><head><title>{title} - Harbour</title></head><body>{html}</body></html>", want))  # noqa: B023, E731
        # Hashed class names.
        add(f'<div class="x9a"><ul class="b1 q">{_MENU}</ul></div><div class="k2 z"><h1 class="h0">{title}</h1>{_ps(lang)}</div><div class="q7"><a href="/a">More</a> <span>{_COPY}</span></div>')
        # No names at all, bare divs for paragraphs.
        add(f"<div><ul>{_MENU}</ul></div><div><h1>{title}</h1>{_ps(lang, 'div')}</div><div>{_LINKS}</div><div>{_COPY}</div>")
        # A wiki.
        add(f'<div id="mw-panel"><div class="portal"><h3>Navigation</h3><ul>{_MENU}</ul></div></div><div id="content"><h1 id="firstHeading">{title}</h1><div id="bodyContent"><div class="mw-parser-output">{_ps(lang)}</div>'
            f'<div id="catlinks"><a href="/c">Categories</a>: <a href="/b">Bridges</a> <a href="/r">Rivers</a></div></div></div><div id="footer"><ul><li>{_COPY}</li><li><a href="/p">Privacy policy</a></li></ul></div>')
        # A newspaper with a thread of comments behind the story.
        talk = "".join(f'<div class="cmt"><b>{a}</b><p>{t}</p></div>' for a, t in _TALK)
        add(f'<div class="mast"><a href="/">Harbour Post</a></div><ul class="sections">{_MENU}</ul><div class="story-text"><h1>{title}</h1>{_ps(lang)}</div><div class="thread"><h3>3 comments</h3>{talk}</div><div class="colophon">{_COPY}</div>')
        # A table layout of old.
        add(f'<table width="100%"><tr><td colspan="2"><a href="/">Harbour Post</a></td></tr><tr><td width="120"><a href="/n">News</a><br><a href="/s">Sport</a><br><a href="/w">Weather</a></td><td><font size="5"><b>{title}</b></font>{_ps(lang)}</td></tr>'
            f'<tr><td colspan="2"><small>{_COPY}</small></td></tr></table>')
        # Components of a framework with scrambled names.
        add(f'<div id="__next"><div class="css-1dbjc4n r-18u37iz"><a class="css-4rbku5" href="/">Harbour</a><a class="css-4rbku5" href="/l">Log in</a></div><div class="css-175oi2r"><div class="css-901oao">{title}</div>'
            + "".join(f'<div class="css-1jxf684"><span>{x}</span></div>' for x in ps) + f'</div><div class="css-17bb2tj"><div>{_ADS}</div></div><div class="css-aa3z"><span>{_COPY}</span></div></div>')
        # A weblog with a list of older entries beside it.
        older = "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(("Rain again", "The harbour feast", "My new boat", "Notes on rope")))
        add(f'<div class="bloghead"><h2><a href="/">Notes from the quay</a></h2></div><div class="entry"><h2>{title}</h2>{_ps(lang)}</div><div class="older"><h4>Older entries</h4><ul>{older}</ul></div><p>{_COPY}</p>')
        # HTML 5 without names.
        add(f"<header><a href='/'>Harbour Post</a></header><nav><ul>{_MENU}</ul></nav><main><h1>{title}</h1>{_ps(lang)}</main><aside><p>{_ADS}</p></aside><footer><p>{_COPY}</p></footer>")
    return out
