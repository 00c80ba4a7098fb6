"""Training of the tagger for personal information: python -m lodeline.llm.train_pii DIR [OUT].

Labelled spans are made: sentences of the documents of DIR, and messages made up of sentences that many messages share (and so tell nothing of a person), are the carriers, into which names, numbers, mail and postal addresses are put with
words that lead to them, or bare. Names come from lists of frequent names and from syllables, numbers from the forms of public numbering plans, addresses from the ways
they are written. Exercises, books and stories with numbers and names of the same kind are carriers too, and unlabelled. Further rounds read at most SAMPLE messages of DIR
with the network of the round before, and train on what it found there besides (self-training; nothing there was labelled by a rule, but what lies in words that many messages share is taken back). Adam on the CRF's log-likelihood, all in numpy.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow.dataset as ds

from lodeline.llm import pii as P
from lodeline.llm.language import language

SAMPLE, MADE, ROUNDS, BATCH, HIDDEN, EMB, SEED, RATE = 40_000, 20_000, (6, 3, 3, 3), 96, 40, 32, 23, 6e-3
#: Share of numbers and mail addresses that stand in the middle of any sentence, without words that lead to them.
LOOSE = 0.15
#: Different messages that a sentence (its digits apart) must stand in to be taken for common words without anything personal.
COMMON = 6

# Frequent names of several countries, from public name statistics.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷曲盛冉蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑"
COMPOUND = "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 钟离 澹台 司徒 夏侯 宇文 长孙 端木 南宫".split()
GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华文玉建国红梅志海波宁雪飞鹏浩宇轩子涵欣怡梓晨诗琪佳俊豪思远嘉雨泽一诺可馨皓然若曦天佑博雅安琪乐童心悦书瑶亦凡景行知予清和星辰沐阳语桐云舒望川听砚苒汐"
FIRST = "James Mary John Emma Oliver Sophie Noah Grace Liam Chloe Jack Amelia Thomas Charlotte Peter Hannah Lukas Anna Jonas Greta Felix Mia Paul Lena Finn Johanna Moritz Clara Jürgen Käthe Hugo Camille Louis Manon Léo Inès Jules Élodie Gabriel Zoé Étienne Agathe Mateo Lucía Hugo Carmen Álvaro Noelia Diego Pilar Iker Beatriz Marco Giulia Luca Chiara João Inês Tiago Daan Sanne Björn Astrid Lars Ingrid Mikko Aino Ivan Olga Piotr Agnieszka Tomáš Zuzana Ahmed Fatima Omar Layla Priya Arjun Ravi Meera Kenji Yuki Minh Linh Kofi Ama Siobhán Ciarán".split()
LAST = "Smith Jones Taylor Brown Wilson Evans Walker White Roberts Green Hall Wood Harris Clarke Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Zimmermann Hoffmann Krüger Vogel Martin Bernard Dubois Thomas Robert Durand Leroy Moreau Lefèvre Rousseau Girard Mercier García López Martínez Sánchez Pérez Gómez Ruiz Hernández Torres Navarro Iglesias Rossi Russo Ferrari Bianchi Silva Santos Oliveira Jansen Bakker Visser Håkansson Lindqvist Andersen Virtanen Novak Kowalska Horváth O'Neill O'Brien MacDonald McGregor Khan Patel Sharma Singh Nakamura Nguyen Mensah Haddad".split()
PARTICLES = "van|van der|von|de|de la|del|di|da|la|le".split("|")
SYLLABLES = "an ar bel ber bra cas cor dal dan den dor el en fal fen fer gal gar hal har hol il jan jor kal kar ken lan lar len lin lor mar mel mer mor nal nor ol or pen per quin ral ren ron sal sel ser sol tal tan ter tor ul ur val ven ver wal wen wil yor zan mör län bär grü tür ßen élo ané eñ iño aú öst vå çon quill moss thist clo chan pre bel val monte aria piedra fuente".split()
ENDS = {"first": ["a", "o", "e", "in", "us", "ia", "el", "is", "ka", "ne", ""], "last": ["son", "ley", "ton", "wood", "well", "hurst", "field", "ridge", "mann", "berg", "stein", "feld", "hof", "au", "eau", "ier", "ard", "ez", "ero", "al", "ini", "sen", "man", "er", "ow"]}
PLACE_HAN = "东西南北山水江河湖海云龙凤金银石桥林青红白兰梅竹松清平安宁永新长春秋星月风华丰光明和兴福泉溪沙岭坪塘州阳川汀鸢梭砚渡屿"
H = "[一-鿿]"
HIDDEN_MARKS = "[手机号已隐藏] [邮箱已隐藏] [证件号已隐藏] [姓名已隐藏] [地址已隐藏] [phone hidden] [email removed] <PHONE> <NAME> ***".split(" ")

#: Words that lead to what is put in, or stand around it; {x} is its place.
FRAMES = {
    "zh": {
        "name": "我叫{x}，|我是{x}，|大家好，我是{x}。|我的名字是{x}。|我是{g}年级{g}班的{x}，|我是{g}班的{x}，|{g}班的{x}：|{x}同学，你好！|好的，{x}，|你好，{x}！|{x}家长：|家长{x}留言：|学生家长{x}：|班主任{x}布置的：|数学老师{x}说，|我同桌{x}也不会，|和我一组的是{x}，|同组的{x}说，|帮{x}问一下，|替{x}问一下，|（{x}代问）|——{x}|—— {x}|\n{x}| - {x}|\n—{x}|{x}，{g}年级|我妈妈{x}说，|请转告{x}老师，|谢谢，{x}|姓名：{x}。|学生姓名：{x}，|{x}敬上|\n此致\n{x}|我和{x}一起做的，|我朋友{x}问，|{x}的妈妈问，|请{x}老师看看，|（{x}）| {x}|署名：{x}|我爸爸叫{x}，|{x}问：|{x}：|是{x}告诉我的，|{x}坐在我旁边，|坐我后面的{x}说，|{x}也想知道，",
        "phone": "电话{x}，|手机号：{x}，|打{x}找我爸爸，|我的电话是{x}，|请拨{x}，|联系方式：{x}|微信同号{x}|座机{x}，|回电{x}|（{x}）|加我{x}，|妈妈的手机 {x}，|有事打{x}。| {x}|\n{x}|爸爸电话：{x}。|手机 {x}|别公开{x}。|请保密：{x}。|有空打{x}，|（记下了：{x}）|{x}，谢谢！",
        "email": "邮箱：{x}，|发到{x}，|我的邮箱是{x}，|请发邮件到 {x}，|联系 {x}。|（{x}）| {x}|E-mail: {x}|答案发我{x}谢谢|\n{x}|邮件 {x}，|别公开{x}。|请保密：{x}。|（回复到：{x}）|答案请发到{x}！",
        "id_number": "身份证号{x}，|证件号：{x}，|我的证件号是{x}，|护照号 {x}，|学籍号{x}，|身份证是{x}。|（{x}）|证件{x}，|报名用的号码是{x}，| {x}|\n证件号 {x}|\n{x}|别公开{x}。|请保密：{x}。|{x}，谢谢！",
        "address": "我家住在{x}，|地址：{x}。|寄到{x}，|住址是{x}，|我住{x}，|家在{x}，|请送到{x}。|收件地址 {x}|（{x}）| {x}|\n{x}|从{x}出发，|我家在{x}，|书请寄{x}，|在{x}等我，|放学后在{x}等，|别公开{x}。|我们搬到{x}了。|请保密：{x}。",
    },
    "en": {
        "name": "My name is {x}. |I am {x}. |I'm {x}, |This is {x}, |This is {x} from {n}B. |{x} here. |Hello {x}! |Hi {x}, |Good question, {x}. |Well done, {x}! |Dear {x}, |Thanks, {x}|\n{x}| - {x}| -- {x}|\nYours, {x}|Written by {x}|Signed: {x}|(asked by {x})|My friend {x} asks: |My mum {x} says |Name: {x}. |Our teacher {x} says |I am the parent of {x}. |{x}, year {n}. |{x}: |Ask {x}, |Regards\n{x}|({x})| {x}|My partner {x} and I wonder: |for {x}, |It's {x} again. |{x} sits behind me and asks: |{x} is in my class. |{x} wants to know: |Do not share {x}. ",
        "phone": "Call {x}. |My number is {x}, |Phone: {x}. |Text me on {x}. |You can reach my dad at {x}. |Tel. {x} |({x})| {x}|\n{x}|Mobile {x}, |Ring {x} please. |My mum's phone is {x}. |call me on {x}|text {x} |My number: {x}. |Do not share {x}. |text {x} - |{x}, thanks. |Please keep {x} private. |Ring me: {x}! ",
        "email": "My email is {x}. |Write to {x}, |Email: {x} |Send it to {x} please. |({x})| {x}|\n{x}|Mail {x}. |Answer me at {x}, |contact {x}|(answer to: {x})|Do not share {x}. ",
        "id_number": "My ID is {x}. |ID number: {x}. |Passport {x}. |My passport number is {x}, |SSN {x}. |({x})|National insurance number {x}. | {x}|The card says {x}. |My student card number is {x}. |\n{x}|They ask for my number {x}. |The form wants {x}. |The form needs my number {x}. |Do not share {x}. |Please keep {x} private. |{x}, thanks. ",
        "address": "I live at {x}. |My address is {x}. |Address: {x}. |We live at {x}, |Send the book to {x}. |({x})| {x}|\n{x}|Our house is {x}. |I walk home to {x}. |Post it to {x}, please. |We moved to {x}. |We live at {x}. |Please keep {x} private. ",
    },
    "fr": {
        "name": "Je m'appelle {x}. |Je suis {x}. |Moi c'est {x}, |Ici {x}, en CM{n}. |Bonjour {x} ! |Bravo {x} ! |Très bien, {x}. |Merci, {x}|\n{x}| - {x}|\nSigné : {x}|(question de {x})|Mon ami {x} demande : |Ma maman {x} dit |Nom : {x}. |La maîtresse {x} dit |Écrit par {x}|{x}, classe de CE{n}. |Chère {x}, |({x})| {x}|C'est {x} qui demande. |Avec {x}, on cherche : ",
        "phone": "Appelle le {x}. |Mon numéro est le {x}, |Téléphone : {x}. |Tél. {x} |({x})| {x}|\n{x}|Portable {x}. |Papa est joignable au {x}. ",
        "email": "Mon adresse mail est {x}. |Écris à {x}, |Courriel : {x} |Réponds à {x}. |({x})| {x}|\n{x}|Mail : {x}. ",
        "id_number": "Mon numéro est {x}. |Numéro de sécurité sociale {x}. |Passeport {x}. |Carte d'identité {x}, |({x})| {x}|N° d'identité : {x}. |\n{x}|Sur ma carte : {x}. ",
        "address": "J'habite {x}. |J'habite au {x}. |Mon adresse : {x}. |Envoie le livre au {x}. |On habite {x}, |({x})| {x}|\n{x}|Adresse : {x}. |Je rentre au {x}. ",
    },
    "de": {
        "name": "Ich heiße {x}. |Ich bin {x}. |Mein Name ist {x}. |Hier ist {x} aus der {n}b. |Hier spricht {x}. |Hallo {x}! |Gut gefragt, {x}. |Liebe {x}, |Lieber {x}, |Danke, {x}|\n{x}| - {x}|\nViele Grüße\n{x}|(fragt {x})|Meine Freundin {x} fragt: |Mein Papa {x} sagt |Name: {x}. |Unsere Lehrerin {x} sagt |Geschrieben von {x}|{x}, Klasse {n}. |({x})| {x}|Mit {x} zusammen überlege ich: |Gefragt von {x}. ",
        "phone": "Ruf an: {x}. |Meine Nummer ist {x}, |Telefon: {x}. |Tel. {x} |({x})| {x}|\n{x}|Handy {x}. |Mama hat die {x}. |Papas Nummer ist {x}. ",
        "email": "Meine Mail ist {x}. |Schreib an {x}, |E-Mail: {x} |Antwort bitte an {x}. |({x})| {x}|\n{x}|Mail {x}. ",
        "id_number": "Meine Ausweisnummer ist {x}. |Ausweis {x}. |Passnummer {x}. |({x})| {x}|Die Nummer auf dem Ausweis ist {x}. |Personalausweis: {x}, |Meine Nummer im Ausweis: {x}. |\n{x}|Im Pass steht {x}. ",
        "address": "Ich wohne in der {x}. |Ich wohne {x}. |Meine Adresse: {x}. |Schick das Buch an {x}. |Wir wohnen {x}, |({x})| {x}|\n{x}|Adresse: {x}. |Zu Hause bin ich {x}. |Ich wohne hier: {x}. |Wir sind umgezogen: {x}. ",
    },
    "es": {
        "name": "Me llamo {x}. |Soy {x}. |Soy {x}, de {o}. |Mi nombre es {x}. |¡Hola, {x}! |Muy bien, {x}. |Gracias, {x}|\n{x}| - {x}|\nFirmado: {x}|(pregunta de {x})|Mi amiga {x} pregunta: |Mi mamá {x} dice |Nombre: {x}. |La maestra {x} dice |Escrito por {x}|{x}, clase {n}. |Querida {x}, |({x})| {x}|Con {x} pensamos: |Te habla {x}. ",
        "phone": "Llama al {x}. |Mi número es {x}, |Teléfono: {x}. |Tel. {x} |({x})| {x}|\n{x}|Móvil {x}. |Papá está en el {x}. ",
        "email": "Mi correo es {x}. |Escribe a {x}, |Correo: {x} |Responde a {x}. |({x})| {x}|\n{x}|Mail: {x}. ",
        "id_number": "Mi DNI es {x}. |DNI {x}. |NIE {x}. |Pasaporte {x}. |({x})| {x}|El número de mi carné es {x}. |Documento: {x}, |Mi documento es {x}. |\n{x}|{x}, gracias. ",
        "address": "Vivo en {x}. |Vivo en la {x}. |Mi dirección es {x}. |Manda el libro a {x}. |Vivimos en {x}, |({x})| {x}|\n{x}|Dirección: {x}. |Mi casa está en {x}. ",
    },
}
#: The same kinds of words and numbers where they are no personal information: exercises, books and stories. {f} figure, {p} place, {b} big number, {k} small number, {i} book number, {s} street or place with a number.
PLAIN = {
    "zh": "{f}早上数了{k}个书签，下午又数了{k}个，一共多少个？|故事里那个叫{f}的孩子为什么难过？|《{p}》里的{f}爷爷是个怎样的人？|{b} × {k} 这样的大数怎么检查？|{b} 这个十八位数怎么读？|课本编号{i}的第{k}页第{k}题怎么做？|从家到{p}路口要走{k}米，要几分钟？|{f}住在{k}楼，每层{k}级台阶。|圆周率是3.14159265358979吗？|{f}和{f}谁跑得快？|2026年{k}月{k}日是星期几？|{f}问：“这是第{k}题吗？”|课文里的{f}说了什么？|诗人{f}写了这首诗。|{b} 能被3整除吗？|电话{m}，|我叫{m}，|密码锁有{k}位数，号码是{k}{k}，|{p}街有{k}盏路灯。|应用题里说“{f}住在{p}路{k}号”，|主人公{f}最后去了{p}。|书上的例子里{f}有{k}本书。|计算{b}+{b}。",
    "en": "{f} counted {k} shells and then {k} more. How many in all?|In the tale, who is {f} and why does he live at the end of the lane?|How do I read the number {b}?|Is {b} an even number?|What is {b} × {k}?|Book {i}, page {k}, exercise {k}: how do I do it?|It is {k} metres from home to {p} Street. How long do I walk?|{f} lives on floor {k}.|Why is {f} sad in the story?|The poem was written by {f}.|In our book, {f} says he cannot help.|Pi is 3.14159265358979, right?|Call {m}. |{f} and {f} share {k} apples.|The hero {f} walks to {p}.|Is 2026-03-{k} a Sunday?|There are {k} lamps in {p} Lane.|Read chapter {k} about {f}.",
    "fr": "{f} a compté {k} billes puis {k}. Combien en tout ?|Dans le conte, qui est {f} ?|Comment lire le nombre {b} ?|Le nombre {b} est-il pair ?|Livre {i}, page {k}, exercice {k} ?|{f} habite au {k}e étage.|Il y a {k} mètres jusqu'à la rue de {p}.|Pourquoi {f} est-il triste dans l'histoire ?|Le héros {f} part pour {p}.|Calcule {b} + {k}.|Appelle {m}. |{f} et {f} partagent {k} pommes.|La poésie est de {f}.",
    "de": "{f} hat {k} Zapfen und bekommt {k} dazu. Wie viele sind es?|Wer ist {f} im Märchen?|Wie lese ich die Zahl {b}?|Ist {b} eine gerade Zahl?|Buch {i}, Seite {k}, Aufgabe {k}?|{f} wohnt im {k}. Stock.|Bis zur {p}straße sind es {k} Meter.|Warum ist {f} in der Geschichte traurig?|Der Held {f} zieht nach {p}.|Rechne {b} + {k}.|Ruf {m} an. |{f} und {f} teilen {k} Äpfel.|Das Gedicht ist von {f}.",
    "es": "{f} contó {k} fichas y luego {k}. ¿Cuántas en total?|¿Quién es {f} en el cuento?|¿Cómo se lee el número {b}?|¿Es par el número {b}?|Libro {i}, página {k}, ejercicio {k}.|{f} vive en el piso {k}.|Hasta la calle de {p} hay {k} metros.|¿Por qué está triste {f} en la historia?|El héroe {f} viaja a {p}.|Calcula {b} + {k}.|Llama a {m}. |{f} y {f} comparten {k} manzanas.|El poema es de {f}.",
}


class Maker:
    """Labelled messages."""

    def __init__(self, carriers: dict[str, list[str]], pick: random.Random) -> None:
        self.carriers, self.pick = carriers, pick
        self.han = sorted({c for t in carriers["zh"][:3000] for c in re.findall(H, t)}) or list(GIVEN)

    def digits(self, form: str) -> str:
        """A number by form: # any digit, N 1 to 9, A a capital, other signs as they are."""
        pick = self.pick
        return "".join(pick.choice("0123456789") if c == "#" else pick.choice("123456789") if c == "N" else pick.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)

    def word(self, kind: str) -> str:
        pick = self.pick
        if pick.random() < 0.45:
            return pick.choice(FIRST if kind == "first" else LAST)
        return ("".join(pick.choices(SYLLABLES, k=pick.choice([1, 1, 2]))) + pick.choice(ENDS[kind])).capitalize()

    def name(self, lang: str) -> str:
        pick, r = self.pick, self.pick.random()
        if lang == "zh" and r < 0.97:
            sur = pick.choice(COMPOUND) if pick.random() < 0.1 else pick.choice(SURNAMES if pick.random() < 0.85 else self.han)
            return sur + "".join(pick.choice(GIVEN) if pick.random() < 0.6 else pick.choice(self.han) for _ in range(pick.choice([1, 2, 2])))
        first, last = self.word("first"), self.word("last")
        if pick.random() < 0.08:
            first += "-" + self.word("first")
        if pick.random() < 0.08:
            last += "-" + self.word("last")
        if pick.random() < 0.2:
            last = f"{pick.choice(PARTICLES)} {last}"
        elif lang == "es" and pick.random() < 0.5:
            last += " " + self.word("last")
        elif pick.random() < 0.05:
            last = pick.choice(["St. ", "O'", "d'", "D'"]) + last
        name = f"{first} {last}" if r < 0.62 else f"{last}, {first}" if r < 0.8 else f"{first} {pick.choice('ABCDEHJKLMRSTW')}. {last}" if r < 0.92 else f"{first} {self.word('first')} {last}"
        return name.lower() if pick.random() < 0.2 else name.upper() if pick.random() < 0.03 else name

    def phone(self, lang: str) -> str:
        pick = self.pick
        forms = {
            "zh": ["1N#########", "1N# #### ####", "1N#-####-####", "+86 1N#########", "+86 1N# #### ####", "(+86) 1N#########", "（+86）1N#########", "0086-1N#########", "+861N#########", "0NN-########", "(0NN) ########", "0N##-#######", "（0N##）#######", "0N##-###-####", "(0N##)###-####", "0N## ########"],
            "en": ["0N### ######", "0N###-######", "+44 N### ######", "+44 (0)N### ######", "0N## ### ####", "(N##) N##-####", "N##-N##-####", "+1 N## N## ####", "1-N##-N##-####", "N##.N##.####", "N##-####", "+1-N##-N##-####", "(N##) N## ####", "(N##)  N##-####"],
            "fr": ["0N ## ## ## ##", "0N.##.##.##.##", "+33 N ## ## ## ##", "0N########", "+33 (0)N ## ## ## ##", "+33 N########", "+33N########"],
            "de": ["0N# ########", "0N##/######", "0NN / #####-###", "+49 NN ########", "(0NN) #####-###", "+49 (0)N# ####-###", "01N# #######", "0N# #####-###", "(0N#) #####-###", "0N# / #####-###", "+49 N# #####-###"],
            "es": ["+34 N## ### ###", "N## ### ###", "+34 N## ## ## ##", "N########", "N## ## ## ##", "+34 N########"],
        }
        text = self.digits(pick.choice(forms[lang if pick.random() < 0.9 else pick.choice(list(forms))]))
        if pick.random() < 0.12:  # separators are mixed now and then
            places = [i for i, c in enumerate(text) if c in " .-/" and text[i - 1].isdigit() and text[i + 1 : i + 2].isdigit()]
            for i in places[: pick.choice([0, 1, 2])] or places[-1:]:
                text = text[:i] + pick.choice(" .-") + text[i + 1 :]
        r = pick.random()
        if lang == "zh" and r < 0.06:
            return self.digits("1N#########").translate(str.maketrans("0123456789", pick.choice(["〇一二三四五六七八九", "零一二三四五六七八九"])))
        return text.translate(str.maketrans("0123456789", "０１２３４５６７８９")) if lang == "zh" and r < 0.14 else text

    def id_number(self, lang: str) -> str:
        pick = self.pick
        year = f"{pick.choice(['19', '20'])}{pick.randrange(100):02d}{pick.randrange(1, 13):02d}{pick.randrange(1, 29):02d}"
        forms = {
            "zh": [f"N#####{year}##%", f"N#####{year}##%", f"N##### {year} ##%", f"GN#####{year}###%", "A########", "A########", "AA#######"],
            "en": ["###-##-####", "### ## ####", "AA ## ## ## A", "AA######A", "A########", "AA ## ## ## A", "000 ## ####", "000-##-####"],
            "fr": ["N ## ## ## ### ### ##", "##AA#####", "N ## ## ## ### ### ##"],
            "de": ["A#####A##", "A########", "AA#######", "A##A##A##", "A####A###"],
            "es": ["########-A", "########A", "A-#######-A", "A#######A", "A-########", "0000####A", "0000####-A"],
        }
        text = self.digits(pick.choice(forms[lang if pick.random() < 0.9 else pick.choice(list(forms))])).replace("%", pick.choice("0123456789Xx"))
        return text.translate(str.maketrans("0123456789X", "０１２３４５６７８９Ｘ")) if lang == "zh" and pick.random() < 0.08 else text

    def email(self, lang: str) -> str:
        pick = self.pick
        part = lambda: "".join(pick.choices(SYLLABLES, k=pick.choice([1, 2, 2, 3])))
        local = part() + pick.choice(["", "", ".", "_", "-", "+"])
        local = (local + part() if local[-1] in "._-+" else local) + pick.choice(["", "", self.digits("##"), self.digits("####")])
        host = part() + pick.choice(["", "-" + part()]) + pick.choice(["", "", ".mail", "." + part()])
        tld = pick.choice(["com", "org", "net", "de", "fr", "es", "cn", "example", "edu", "co.uk", "com.cn", "example.com", "example.org", "example.net"])
        at, dot = pick.choice([("@", ".")] * 8 + [(" (at) ", "."), (" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("＠", "."), (" @ ", "."), ("（at）", ".")])
        text = local + at + f"{host}.{tld}".replace(".", dot)
        r = pick.random()
        if r < 0.05:
            return text.translate({c: c + 0xFEE0 for c in range(0x21, 0x7F)} if dot == "." and at == "@" else {})
        return text.upper() if r < 0.08 else text.title() if r < 0.1 else text

    def address(self, lang: str) -> str:
        pick = self.pick
        two = lambda: "".join(pick.choices(PLACE_HAN if pick.random() < 0.6 else self.han, k=2))
        n, big = (lambda top: str(pick.randrange(1, top))), self.word("last")
        big = f"{big}-{self.word('last')}" if pick.random() < 0.15 and lang != "en" else big
        town = lambda: self.word("last") + (pick.choice(["-Süd", "-Nord", "-" + self.word("last")]) if pick.random() < 0.2 else "")
        if lang == "zh":
            house = n(400)
            house = house.translate(str.maketrans("0123456789", "０１２３４５６７８９")) if pick.random() < 0.1 else pick.choice(["一", "七", "十二", "三十六", "一百零八", "二十"]) if pick.random() < 0.1 else house
            if pick.random() < 0.2:
                return f"{pick.choice(['', two() + '省', two() + '市'])}{two()}县{two()}{pick.choice('镇乡')}{two()}村{pick.choice(['', n(9) + '组'])}{house}号"
            head = pick.choice(["", two() + "市", two() + "省" + two() + "市", two() + "市" + two() + "区", two() + "区", two() + "市" + two() + "县"])
            tail = pick.choice(["", "", n(20) + "单元" + n(900) + "室", n(30) + "栋" + n(900) + "室", n(30) + "号楼" + n(9) + "单元", n(900) + "室", "附" + n(9) + "号"])
            lane = n(90) + "弄" if pick.random() < 0.15 else ""
            return f"{head}{two()}{pick.choice(['路', '路', '街', '大街', '大道', '巷', '胡同', '里'])}{lane}{house}号{tail}"
        if lang == "en":
            road = pick.choice(["Street", "Road", "Lane", "Close", "Way", "St", "Rd", "Ave.", "Avenue", "Drive", "Court", "Hill", "St.", "Rd."])
            city = self.word("last")
            forms = [f"{n(300)} {big} {road}", f"{n(300)} {big} {road}, {city}", f"Flat {n(40)}, {n(300)} {big} {road}, {city}", f"{n(300)} Old {big} {road}", f"{n(300)} {big} {road}, Apt {n(40)}{pick.choice(['', 'A', 'B'])}", f"No. {n(90)}, {big} {road}, {city}", f"{n(90)} {big} {road}".lower(),
                     f"{big} Cottage, {pick.choice(['Upper', 'Lower', 'Great', 'Little', 'Nether'])} {city}", f"{n(300)} {big} {road}, {city} {self.digits('#####')}", f"{n(99)}{pick.choice('abc')} {big} {road}"]
            return pick.choice(forms)
        if lang == "fr":
            way = pick.choice(["rue", "avenue", "av.", "place", "chemin", "bd", "boulevard", "allée", "impasse"])
            link = pick.choice(["de ", "du ", "des ", "de la ", "d'", "", "de l'", "les "])
            return f"{n(200)}{pick.choice(['', '', ' bis', ' ter'])}{pick.choice(['', ','])} {way} {link}{big}{pick.choice(['', ', ' + self.digits('#####') + ' ' + town()])}"
        if lang == "de":
            street = pick.choice([f"{big}straße", f"{big}str.", f"{big}weg", f"{big}gasse", f"{big}platz", f"Am {big}", f"An der {big}", f"{big}allee", f"Im {big}", f"Zur {big}", f"{big}-{self.word('last')}-Straße"])
            return f"{street} {n(200)}{pick.choice(['', '', 'a', 'b'])}{pick.choice(['', '', ', ' + self.digits('#####') + ' ' + town(), ', ' + town()])}"
        way = pick.choice(["Calle", "Avda.", "Plaza", "Paseo", "C/", "Avenida", "Camino"])
        link = pick.choice(["", "de ", "del ", "de la ", "de los "])
        return f"{way} {link}{big}{pick.choice(['', ' ' + self.word('last')])}{pick.choice([',', ''])} {n(200)}{pick.choice(['', '', ', ' + self.digits('#####') + ' ' + self.word('last'), f', {n(9)}.º {pick.choice("ABC")}', f', {n(9)}.º {pick.choice("ABC")}, ' + self.word('last')])}"

    def plain(self, lang: str) -> str:
        """A sentence of an exercise, a book or a story."""
        pick = self.pick

        def put(m: re.Match) -> str:
            c = m[1]
            if c == "f":
                return self.name(lang) if pick.random() < 0.5 else (pick.choice(self.han) + pick.choice(self.han)) if lang == "zh" else self.word("first")
            if c == "p":
                return "".join(pick.choices(self.han, k=2)) if lang == "zh" else self.word("last")
            if c == "b":
                return self.digits(pick.choice(["1N#########", "N###########", "N" + "#" * 15, "N" + "#" * 17, "N######", "N########", "N#####", f"N#####{pick.choice([19, 20])}######"]))
            if c == "i":
                return self.digits(pick.choice(["978-#-###-#####-#", "979-#-###-#####-#", "978-#-####-####-#", "978##########", "ISBN 978-#-##-######-#"]))
            return pick.choice(HIDDEN_MARKS) if c == "m" else str(pick.randrange(1, pick.choice([10, 100, 1000])))

        return re.sub(r"\{([fpbkims])\}", put, pick.choice(PLAIN[lang].split("|")))

    def message(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A message and its spans: carriers and sentences of exercises, with up to three pieces of personal information before, between and behind them."""
        pick = self.pick
        lang = pick.choices(["zh", "en", "fr", "de", "es"], [40, 20, 13, 13, 14])[0]
        body = [self.plain(lang) if pick.random() < 0.5 else pick.choice(self.carriers[lang]) for _ in range(pick.choice([1, 1, 1, 2, 3]))]
        r = pick.random()
        if r < 0.04:
            body = [b.upper() for b in body]
        elif r < 0.08:
            body = ["".join(c + " " * (pick.random() < 0.12) for c in b) for b in body]
        slots = [("text", b) for b in body]
        for _ in range(pick.choice([0, 0, 1, 1, 1, 1, 2, 3])):
            slots.insert(pick.choice([0, len(slots), len(slots), pick.randrange(len(slots) + 1)]), ("find", pick.choices(P.TYPES, [34, 12, 18, 18, 18])[0]))
        text, spans = pick.choice(["", "", "", "老师，" if lang == "zh" else "Hi! " if lang == "en" else ""]), []
        for what, x in slots:
            if text and text[-1] not in " \n，。！？：（" and lang != "zh":
                text += " "
            if what == "text":
                text += x
                continue
            if x != "name" and x != "address" and pick.random() < LOOSE:  # in the middle of any sentence
                words = pick.choice(self.carriers[lang])
                at = pick.choice([m.end() for m in re.finditer(r"\s|，|$", words)])
                value = getattr(self, x)(lang)
                text += words[:at]
                spans.append((len(text), len(text) + len(value), x))
                text += f"{value} {words[at:]}"
                continue
            frame = re.sub(r"\{g\}", pick.choice("一二三四五六"), pick.choice(FRAMES[lang][x].split("|")))
            frame = frame.replace("{n}", str(pick.randrange(1, 7))).replace("{o}", pick.choice(["primero", "segundo", "tercero", "cuarto", "quinto", "sexto"]))
            before, after = frame.split("{x}")
            value = getattr(self, x)(lang)
            if before[:1] == "\n":
                text = text.rstrip(" ")
            text += before
            spans.append((len(text), len(text) + len(value), x))
            text += value + after
        return text, spans


def gold(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for s, e, kind in spans:
        y[s:e] = P.TAGS.index(f"I-{kind}")
        y[s] = P.TAGS.index(f"B-{kind}")
    return y


class Net:
    """The network with gradients."""

    def __init__(self, vocabulary: list[str], rng: np.random.Generator) -> None:
        k, r = len(P.TAGS), lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        self.p = {"chars": r(len(vocabulary) + 1, EMB) * 4, "classes": r(P.CLASSES, EMB), "out": r(2 * HIDDEN, k), "out_bias": np.zeros(k, np.float32), "trans": r(k, k) * 0.1, "start": np.zeros(k, np.float32), "end": np.zeros(k, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"in_{d}": r(EMB, 4 * HIDDEN), f"recur_{d}": r(HIDDEN, 4 * HIDDEN), f"bias_{d}": bias}
        self.m = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.v = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.t = 0

    def direction(self, x: np.ndarray, d: str) -> tuple:
        recur, h = self.p[f"recur_{d}"], HIDDEN
        z = x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"]
        steps, batch = z.shape[:2]
        hid, cell = np.zeros((steps + 1, batch, h), np.float32), np.zeros((steps + 1, batch, h), np.float32)
        act, tc = np.empty_like(z), np.empty((steps, batch, h), np.float32)
        for t in range(steps):
            a = z[t] + hid[t] @ recur
            a[:, : 3 * h] = P.sigmoid(a[:, : 3 * h])
            a[:, 3 * h :] = np.tanh(a[:, 3 * h :])
            act[t] = a
            cell[t + 1] = a[:, h : 2 * h] * cell[t] + a[:, :h] * a[:, 3 * h :]
            tc[t] = np.tanh(cell[t + 1])
            hid[t + 1] = a[:, 2 * h : 3 * h] * tc[t]
        return hid, cell, act, tc

    def back(self, grad: np.ndarray, saved: tuple, x: np.ndarray, d: str, g: dict) -> np.ndarray:
        hid, cell, act, tc = saved
        recur, h = self.p[f"recur_{d}"], HIDDEN
        dz = np.empty_like(act)
        dh = np.zeros_like(hid[0])
        dc = np.zeros_like(hid[0])
        for t in range(len(act) - 1, -1, -1):
            a = act[t]
            dh = dh + grad[t]
            dc = dc + dh * a[:, 2 * h : 3 * h] * (1 - tc[t] ** 2)
            dz[t, :, 2 * h : 3 * h] = dh * tc[t]
            dz[t, :, :h] = dc * a[:, 3 * h :]
            dz[t, :, h : 2 * h] = dc * cell[t]
            dz[t, :, 3 * h :] = dc * a[:, :h] * (1 - a[:, 3 * h :] ** 2)
            s = a[:, : 3 * h]
            dz[t, :, : 3 * h] *= s * (1 - s)
            dc = dc * a[:, h : 2 * h]
            dh = dz[t] @ recur.T
        flat = dz.reshape(-1, 4 * h)
        g[f"recur_{d}"] = hid[:-1].reshape(-1, h).T @ flat
        g[f"in_{d}"] = x.reshape(-1, x.shape[2]).T @ flat
        g[f"bias_{d}"] = flat.sum(axis=0)
        return dz @ self.p[f"in_{d}"].T

    def step(self, ids: np.ndarray, cls: np.ndarray, y: np.ndarray, length: np.ndarray, rate: float) -> float:
        steps, batch = ids.shape
        p, each = self.p, np.arange(batch)
        turn = np.where(np.arange(steps)[:, None] < length, length - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        x = p["chars"][ids] + p["classes"][cls]
        xb = x[turn, each]
        f, b = self.direction(x, "f"), self.direction(xb, "b")
        joint = np.concatenate([f[0][1:], b[0][1:][turn, each]], axis=2)
        emit = joint @ p["out"] + p["out_bias"]
        loss, demit, g = self.crf(emit, y, length)
        g["out"] = joint.reshape(-1, joint.shape[2]).T @ demit.reshape(-1, demit.shape[2])
        g["out_bias"] = demit.sum(axis=(0, 1))
        dj = demit @ p["out"].T
        dx = self.back(dj[:, :, :HIDDEN], f, x, "f", g)
        dxb = self.back(dj[:, :, HIDDEN:][turn, each], b, xb, "b", g)
        dx = dx + dxb[turn, each]
        g["chars"], g["classes"] = np.zeros_like(p["chars"]), np.zeros_like(p["classes"])
        np.add.at(g["chars"], ids.ravel(), dx.reshape(-1, EMB))
        np.add.at(g["classes"], cls.ravel(), dx.reshape(-1, EMB))
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 5.0 / (size + 1e-9))
        self.t += 1
        for n, v in g.items():
            v = v * scale
            self.m[n] += 0.1 * (v - self.m[n])
            self.v[n] += 0.005 * (v * v - self.v[n])
            p[n] -= rate * (self.m[n] / (1 - 0.9**self.t)) / (np.sqrt(self.v[n] / (1 - 0.995**self.t)) + 1e-7)
        return loss

    def crf(self, emit: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, dict]:
        p, (steps, batch, k) = self.p, emit.shape
        trans, start, end = p["trans"], p["start"], p["end"]
        alive = np.arange(steps)[:, None] < length
        alpha = np.empty_like(emit)
        alpha[0] = start + emit[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + trans
            top = s.max(axis=1)
            new = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) + emit[t]
            alpha[t] = np.where(alive[t][:, None], new, alpha[t - 1])
        last = alpha[-1] + end
        top = last.max(axis=1, keepdims=True)
        whole = top + np.log(np.exp(last - top).sum(axis=1, keepdims=True))
        beta = np.broadcast_to(end, (batch, k)).copy()
        demit, dtrans = np.zeros_like(emit), np.zeros_like(trans)
        for t in range(steps - 1, -1, -1):
            demit[t] = np.where(alive[t][:, None], np.exp(alpha[t] + beta - whole), 0)
            if t:
                inner = emit[t] + beta
                s = trans + inner[:, None, :]
                pair = np.exp(alpha[t - 1][:, :, None] + s - whole[:, :, None])
                dtrans += pair[alive[t]].sum(axis=0)
                top = s.max(axis=2)
                beta = np.where(alive[t][:, None], top + np.log(np.exp(s - top[:, :, None]).sum(axis=2)), beta)
        dend, dstart = np.exp(last - whole).sum(axis=0), demit[0].sum(axis=0)
        each = np.arange(batch)
        dstart -= np.bincount(y[0], minlength=k)
        dend -= np.bincount(y[length - 1, each], minlength=k)
        score = start[y[0]] + end[y[length - 1, each]]
        for t in range(steps):
            demit[t, each, y[t]] -= alive[t]
            score = score + emit[t, each, y[t]] * alive[t]
            if t:
                score = score + trans[y[t - 1], y[t]] * alive[t]
                np.subtract.at(dtrans, (y[t - 1][alive[t]], y[t][alive[t]]), 1)
        n = batch
        return float((whole[:, 0] - score).mean()), demit / n, {"trans": dtrans / n, "start": dstart / n, "end": dend / n}


def windows(rows: list[tuple[str, list[tuple[int, int, str]]]], index: dict[str, int], pick: random.Random) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for t, s in rows:
        at = max(0, min(pick.randrange(len(t)), len(t) - P.WINDOW)) if len(t) > P.WINDOW else 0
        y, t = gold(t, s)[at : at + P.WINDOW], t[at : at + P.WINDOW]
        if len(y) and P.TAGS[y[0]][0] == "I":
            y[0] -= 1
        out.append((np.array([index.get(c, 0) for c in t]), np.array([P.char_class(c) for c in t]), y))
    return [x for x in out if len(x[0])]


def fit(net: Net, rows_of, epochs: int, index: dict[str, int], rng: np.random.Generator, pick: random.Random, rate: float) -> None:
    done, total = 0, None
    for epoch in range(epochs):
        coded = windows(rows_of(), index, pick)
        order = sorted(range(len(coded)), key=lambda i: (len(coded[i][0]) // 8, pick.random()))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        pick.shuffle(batches)
        total = total or epochs * len(batches)
        losses = []
        for b in batches:
            length = np.array([len(coded[i][0]) for i in b])
            ids, cls, y = (np.zeros((length.max(), len(b)), np.int64) for _ in range(3))
            for j, i in enumerate(b):
                for part, to in zip(coded[i], (ids, cls, y), strict=True):
                    to[: len(part), j] = part
            ids = np.where(rng.random(ids.shape) < 0.06, 0, ids)  # so that unknown characters are learned
            losses.append(net.step(ids, cls, y, length, rate * max(0.03, 1 - done / total)))
            done += 1
        print(f"epoch {epoch + 1}: loss {np.mean(losses):.4f}", flush=True)


def save(net: Net, vocabulary: list[str], out: str) -> None:
    np.savez_compressed(out, vocabulary=np.array([ord(c) for c in vocabulary], np.int32), **{n: v.astype(np.float16) if n in ("chars",) else v for n, v in net.p.items()})


def cut(text: str) -> list[str]:
    """Pieces of a message, up to a mark."""
    return re.findall(r"[^。！？.!?，,:：\n]+[。！？.!?，,:：\n]*\s*", text)


def mask(piece: str) -> str:
    return re.sub(r"\d+", "0", piece.strip())


#: Numbers of six digits and more, written together or apart, and mail signs.
PRIVATE = re.compile(r"\d(?:[ .\-/()（）]*\d){5}|[@＠]|[(\[（]at")


def common_pieces(messages: list[str]) -> set[str]:
    """Pieces that stand in at least COMMON messages but for digits, without long numbers and mail signs."""
    seen = Counter(k for t in messages for k in {mask(s) for s in cut(t) if not PRIVATE.search(s)})
    return {k for k, n in seen.items() if n >= COMMON}


def shared(piece: str, common: set[str]) -> bool:
    """Many messages have the piece; a long number tells of a person even where another number would make it a common piece."""
    return mask(piece) in common and not PRIVATE.search(piece)


def common_words(messages: list[str], common: set[str]) -> dict[str, list[str]]:
    """By language, the common pieces of messages, and whole messages made up of such alone."""
    out: dict[str, list[str]] = {k: [] for k in FRAMES}
    for t in dict.fromkeys(messages):
        pieces = [s for s in cut(t) if shared(s, common)]
        for s in [t] if len(pieces) == len(cut(t)) and not PRIVATE.search(t) else pieces:
            lang = "zh" if len(re.findall(H, s)) > 1 else language(s) or "en"
            if lang in out:
                out[lang].append(s.strip())
    return out


def kept(text: str, spans: list[tuple[int, int, str]], common: set[str]) -> list[tuple[int, int, str]]:
    """Spans that don't lie within words that many messages share."""
    out = spans
    for m in re.finditer(r"[^。！？.!?，,:：\n]+[。！？.!?，,:：\n]*\s*", text) if spans else ():
        if shared(m[0], common):
            out = [x for x in out if not (m.start() <= x[0] and x[1] <= m.end())]
    return out


def without(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its spans blotted out."""
    for s, e, _ in spans:
        text = text[:s] + "*" * (e - s) + text[e:]
    return text


def wrongly(texts: list[str], read: list[list[tuple[int, int, str]]], common: set[str]) -> list[tuple[str, list]]:
    """Pieces that many messages share in which the network found something, as pieces without anything: its errors, to be taught again."""
    out = set()
    for text, spans in zip(texts, read, strict=True):
        for m in re.finditer(r"[^。！？.!?，,:：\n]+[。！？.!?，,:：\n]*\s*", text) if spans else ():
            if shared(m[0], common) and any(m.start() <= s and e <= m.end() for s, e, _ in spans):
                out.add(m[0].strip())
    return [(t, []) for t in sorted(out)]


def saved(net: Net, vocabulary: list[str], out: str) -> P.Tagger:
    save(net, vocabulary, out)
    with np.load(out) as z:
        return P.Tagger(dict(z))


def self_round(net: Net, model: P.Tagger, maker: Maker, texts: list[str], common: set[str], epochs: int, index: dict[str, int], rng: np.random.Generator, pick: random.Random, rate: float) -> None:
    read = P.find_spans(texts, model)
    found = [(t, kept(t, s, common)) for t, s in zip(texts, read, strict=True)]
    full = [(t, s) for t, s in found if s and not PRIVATE.search(without(t, s))]  # a message whose long numbers were not all found is no example
    bare = [(t, s) for t, s in found if not s and not PRIVATE.search(t) and all(shared(c, common) for c in cut(t))]  # what was missed elsewhere is not taught as plain
    wrong = wrongly(texts, read, common)
    print(f"found {Counter(k for _, s in full for *_, k in s)} in {len(full)} of {len(texts)} messages, {len(wrong)} shared sentences taken for personal", flush=True)
    fit(
        net, lambda: [maker.message() for _ in range(MADE // 2)] + pick.sample(full, min(len(full), MADE // 2)) + pick.sample(bare, min(len(bare), MADE // 3)) + pick.choices(wrong, k=min(10 * len(wrong), MADE // 10)),
        epochs, index, rng, pick, rate,
    )


def prepared(data: str, pick: random.Random) -> tuple[Maker, list[str], set[str]]:
    """The maker of messages, messages of the table to read, and the pieces that many of them share."""
    rows = [t for t in ds.dataset(f"{data}/education_messages.parquet").to_table(columns=["content"])["content"].to_pylist() if t and t.strip()]
    common = common_pieces(rows)
    texts = list(dict.fromkeys(rows))
    pick.shuffle(texts)
    texts = texts[:SAMPLE]
    carriers: dict[str, list[str]] = {k: [] for k in FRAMES}
    for r in ds.dataset(f"{data}/documents.parquet").to_table(columns=["lang", "text"]).to_pylist():
        lang = (r["lang"] or "").strip().lower()[:2]
        if lang in carriers and r["text"]:
            carriers[lang] += [x.strip() for x in re.findall(r"[^。！？.!?\n]{6,90}[。！？.!?]", r["text"])[:12]]
    for k, some in common_words(texts, common).items():
        carriers[k] = carriers[k][: len(some)] + some * 2 if some else carriers[k]
        print(k, len(carriers[k]), "carriers", flush=True)
    for v in carriers.values():
        pick.shuffle(v)
    maker = Maker(carriers, pick)
    return maker, texts, common


def refine(data: str, out: str = str(P.MODEL), epochs: int = 6, rate: float = RATE / 3) -> None:
    """One more round from the stored weights: python -m lodeline.llm.train_pii --refine DIR [OUT]."""
    rng, pick = np.random.default_rng(SEED), random.Random(SEED)
    maker, texts, common = prepared(data, pick)
    with np.load(P.MODEL) as z:
        held = dict(z)
    vocabulary = [chr(c) for c in held.pop("vocabulary").tolist()]
    net = Net(vocabulary, rng)
    net.p = {n: v.astype(np.float32) for n, v in held.items()}
    self_round(net, P.tagger(), maker, texts, common, epochs, {c: i + 1 for i, c in enumerate(vocabulary)}, rng, pick, rate)
    save(net, vocabulary, out)


def main(data: str, out: str = str(P.MODEL)) -> None:
    rng, pick = np.random.default_rng(SEED), random.Random(SEED)
    maker, texts, common = prepared(data, pick)
    seen = Counter(c for _ in range(MADE) for c in maker.message()[0]) + Counter(c for t in texts for c in t)
    vocabulary = [c for c, n in seen.items() if n >= 6]
    index = {c: i + 1 for i, c in enumerate(vocabulary)}
    net = Net(vocabulary, rng)
    fit(net, lambda: [maker.message() for _ in range(MADE)], ROUNDS[0], index, rng, pick, RATE)
    for n, epochs in enumerate(ROUNDS[1:]):
        model = saved(net, vocabulary, out)
        self_round(net, model, maker, texts, common, epochs, index, rng, pick, RATE / (2 + n))
    model = saved(net, vocabulary, out)
    hit: Counter = Counter()
    fresh = [maker.message() for _ in range(3_000)]
    for (_, want), got in zip(fresh, P.find_spans([t for t, _ in fresh], model), strict=True):
        for kind in P.TYPES:
            a, b = {x for x in got if x[2] == kind}, {x for x in want if x[2] == kind}
            hit[kind, "both"] += len(a & b)
            hit[kind, "extra"] += len(a - b)
            hit[kind, "missed"] += len(b - a)
    print("made anew:", {k: {w: hit[k, w] for w in ("both", "extra", "missed")} for k in P.TYPES})


if __name__ == "__main__":
    refine(*sys.argv[2:]) if sys.argv[1] == "--refine" else main(*sys.argv[1:])
