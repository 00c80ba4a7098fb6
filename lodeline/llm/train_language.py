"""Training of the n-gram tables of languages in Latin letters: python -m lodeline.llm.train_language DIR [OUT].

Texts are documents by their lang column, at most SAMPLE characters of each language, besides the short texts below, written for this purpose, for
languages that the documents lack (and added to those they have). A table keeps the TOP likeliest n-grams; "" is the floor for others.
"""

from __future__ import annotations

import json
import math
import random
import sys
from collections import Counter

import pyarrow.parquet as pq

from lodeline.llm import language as L

SAMPLE, TOP, SEED = 400_000, 1_500, 31
OWN = {
    "it": """Il cane corre veloce verso casa e il gatto dorme sotto il tavolo. Per trovare la somma aggiungiamo i due numeri e poi scriviamo la risposta. Quanti libri ci sono sulla scrivania della maestra? Non sono sicuro, ma credo che siano nove.
La bambina ha comprato un quaderno nuovo perché quello vecchio era finito. Prima di tutto bisogna leggere bene la domanda, dopo si può cominciare a calcolare. Questo è il motivo per cui gli alberi perdono le foglie in autunno. Mia nonna abita vicino alla stazione e la domenica prepara una torta di mele.
Che cosa significa questa parola nel racconto? Significa che il bambino era molto felice di vedere gli amici. Ogni gruppo riceve dodici matite e nessuna rimane. Se la strada è lunga, conviene fare una pausa. Abbiamo visto anche delle montagne, dei fiumi e qualche piccolo paese.""",
    "pt": """O cão corre depressa para casa e o gato dorme debaixo da mesa. Para achar a soma juntamos os dois números e depois escrevemos a resposta. Quantos livros estão em cima da mesa da professora? Não tenho certeza, mas acho que são nove.
A menina comprou um caderno novo porque o velho já tinha acabado. Primeiro é preciso ler bem a pergunta, depois podemos começar a calcular. Este é o motivo pelo qual as árvores perdem as folhas no outono. A minha avó mora perto da estação e aos domingos faz um bolo de maçã.
O que significa essa palavra no conto? Significa que o menino ficou muito feliz quando viu os amigos. Cada grupo recebe doze lápis e não sobra nenhum. Se o caminho for longo, convém fazer uma pausa. Também vimos montanhas, rios e algumas aldeias pequenas. Você gosta de ler histórias à noite?""",
    "nl": """De hond rent snel naar huis en de kat slaapt onder de tafel. Om de som te vinden tellen we de twee getallen op en daarna schrijven we het antwoord. Hoeveel boeken liggen er op het bureau van de juf? Ik weet het niet zeker, maar ik denk dat het er negen zijn.
Het meisje heeft een nieuw schrift gekocht omdat het oude vol was. Eerst moet je de vraag goed lezen, dan kun je beginnen met rekenen. Dit is de reden waarom de bomen in de herfst hun bladeren verliezen. Mijn oma woont dicht bij het station en bakt op zondag een appeltaart.
Wat betekent dat woord in het verhaal? Het betekent dat de jongen heel blij was toen hij zijn vrienden zag. Elke groep krijgt twaalf potloden en er blijft er geen over. Als de weg lang is, kun je beter even pauze nemen. We hebben ook bergen, rivieren en een paar kleine dorpen gezien.""",
    "en": """The dog runs home quickly and the cat sleeps under the table. How many books are there on the teacher's desk? I am not sure, but I think there are nine. The girl bought a new notebook because the old one was full. My grandmother lives near the station and bakes an apple pie on Sundays.
What does that word mean in the story? It means the boy was very happy when he saw his friends. If the road is long, it is better to take a break. We also saw mountains, rivers and a few small villages.""",
    "fr": """Le chien court vite vers la maison et le chat dort sous la table. Combien de livres y a-t-il sur le bureau de la maîtresse ? Je ne suis pas sûr, mais je crois qu'il y en a neuf. La fille a acheté un nouveau cahier parce que le vieux était plein. Ma grand-mère habite près de la gare et fait une tarte aux pommes le dimanche.
Que signifie ce mot dans l'histoire ? Cela veut dire que le garçon était très heureux quand il a vu ses amis. Si la route est longue, il vaut mieux faire une pause. Nous avons aussi vu des montagnes, des rivières et quelques petits villages.""",
    "de": """Der Hund läuft schnell nach Hause und die Katze schläft unter dem Tisch. Wie viele Bücher liegen auf dem Schreibtisch der Lehrerin? Ich bin nicht sicher, aber ich glaube, es sind neun. Das Mädchen hat ein neues Heft gekauft, weil das alte voll war. Meine Oma wohnt nahe beim Bahnhof und backt sonntags einen Apfelkuchen.
Was bedeutet dieses Wort in der Geschichte? Es bedeutet, dass der Junge sehr froh war, als er seine Freunde sah. Wenn der Weg lang ist, macht man besser eine Pause. Wir haben auch Berge, Flüsse und einige kleine Dörfer gesehen.""",
    "es": """El perro corre rápido hacia casa y el gato duerme debajo de la mesa. ¿Cuántos libros hay en el escritorio de la maestra? No estoy seguro, pero creo que son nueve. La niña compró un cuaderno nuevo porque el viejo estaba lleno. Mi abuela vive cerca de la estación y los domingos hace una tarta de manzana.
¿Qué significa esa palabra en el cuento? Significa que el niño estaba muy contento cuando vio a sus amigos. Si el camino es largo, conviene hacer una pausa. También vimos montañas, ríos y algunos pueblos pequeños.""",
}


def table_of(texts: list[str]) -> dict[str, float]:
    """Log likelihoods: each n-gram's share among those of its length, words counted once a text with damped counts."""
    words: Counter = Counter()
    for t in texts:
        words.update(w.casefold() for w in L.LATIN.findall(L.HAN.sub(" ", t)))
    seen: Counter = Counter()
    for w, n in words.items():
        for g in L.grams(w):
            seen[g] += math.log1p(n)
    whole = [sum(n for g, n in seen.items() if len(g) == size) or 1 for size in range(L.LONGEST + 1)]
    best = sorted(seen, key=lambda g: -seen[g])[:TOP]
    return {"": round(math.log(3e-5), 3)} | {g: round(math.log(max(3e-5, seen[g] / whole[len(g)])), 3) for g in best}


def main(data: str, out: str = str(L.MODEL)) -> None:
    rows = pq.read_table(f"{data}/documents.parquet", columns=["lang", "text"]).to_pylist()
    random.Random(SEED).shuffle(rows)
    texts: dict[str, list[str]] = {k: [v] * 3 for k, v in OWN.items()}
    used: Counter = Counter()
    for r in rows:
        lang = (r["lang"] or "").strip().lower()[:2]
        if lang in OWN and r["text"] and used[lang] < SAMPLE and len(L.LATIN.findall(r["text"])) > 3 * len(L.HAN.findall(r["text"])):
            used[lang] += len(r["text"])
            texts[lang].append(r["text"])
    with open(out, "w", encoding="utf-8") as f:
        json.dump({k: table_of(v) for k, v in texts.items()}, f, ensure_ascii=False, separators=(",", ":"))
    print({k: len(v) for k, v in texts.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
