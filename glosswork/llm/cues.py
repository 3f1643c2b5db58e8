"""Word stems by which residue is known, composed rather than listed as sentences.

A stem stands for all words that begin with it; one that ends in ``_`` is a
whole word. Stems are of some twenty-five languages; a sentence is evidence
only through what it combines, for instance a thing of the web (THING) with
a negation (NOT) and a word for being there (THERE).
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

THING, WEB, NOT, THERE, BAD, ERROR, OCCUR, SCRIPT, NEED, YOU, AGAIN, NOUN, GAP, DUMMY, FILL, FIELD, BLANK, MESSAGE, WITHOUT, SORRY, PART = (1 << i for i in range(21))
#: Marks that are reasons for a closer look at the form of a sentence.
MARK = FIELD | BLANK | MESSAGE

_ODD = {"’": "'", "‘": "'", "`": "'", "´": "'", "‐": "-", "‑": "-", "−": "-", "­": "", "​": "", "﻿": "", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "Ł": "L", "Ø": "O", "ß": "ss"}
_MARKS = [chr(c) for c in range(0x300, 0x370)]


def fold(text: str) -> str:
    """Text without accents, odd quotes, hyphens and spaces, and with wrong decoding undone where that is plain."""
    if text.isascii():
        return text
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    for odd, usual in _ODD.items():  # a few quick searches; str.translate takes each character in turn
        if odd in text:
            text = text.replace(odd, usual)
    return _accents().sub("", unicodedata.normalize("NFKD", text))


@cache
def _accents():
    import re

    return re.compile("[̀-ͯ]+")


# Stems by class; a line for each language or family.
STEMS = {
    THING: """
page_ pages_ site_ website webpage web_page url_ urls_ link_ file_ document_ documents_ server service_ services_ request_ resource_ connection_ session_ access_ address_ login account_ gateway database_ application_ app_ proxy network_ certificate_ permission_ portal_ host_ upstream cache_ content_ location_ query_ this_entry the_entry this_record the_record this_item the_item this_article the_article
seite_ seiten_ dokument_ webseite datei_ dateien_ dienst_ anfrage_ ressource_ verbindung_ sitzung_ zugriff_ zugang_ adresse_ anmeldung_ konto_ datenbank_ anwendung_ netzwerk_ zertifikat_ berechtigung_ inhalt_ der_eintrag dieser_eintrag der_datensatz dieser_artikel
fichier_ serveur requete_ connexion_ acces_ compte_ reseau_ certificat_ autorisation_ contenu_ cette_fiche la_fiche cet_article
pagina paginas_ sitio_ documento_ archivo_ fichero_ servidor servicio_ solicitud_ peticion_ recurso_ conexion_ sesion_ acceso_ direccion_ cuenta_ aplicacion_ certificado_ permiso_ contenido_ esta_ficha la_ficha este_registro esta_entrada este_articulo
sito_ servizio_ richiesta_ risorsa_ connessione_ sessione_ accesso_ indirizzo_ arquivo_ ficheiro_ servico_ pedido_ solicitacao_ conexao_ ligacao_ sessao_ acesso_ endereco_
bestand_ verzoek_ bron_ verbinding_ sessie_ toegang_ adres_ sida_ sidan_ sidans_ siden_ side_ webbplats nettside filen_ begaran_ anslutning tjanst atkomst_ anmodning forbindelse adgang_ tilgang_
sivu sivusto tiedosto palvelin palvelu pyynto yhteys_ istunto paasy_ stron plik_ serwer uslug polaczeni sesj dostep_ strank strank soubor pozadavek pripojeni relac pristup_
oldal_ oldalt_ fajl kiszolgal szerver szolgaltatas kapcsolat munkamenet hozzaferes sayfa dosya_ sunucu baglanti oturum erisim_ fisier serviciul_ conexiun sesiun acces_
страниц сайт файл сервер сервис служб запрос ресурс соединени подключени сесси сеанс доступ_ адрес сторінк сторинк з'єднанн σελιδα διακομιστ αρχειο συνδεση προσβαση
页面 网页 頁面 網頁 网站 網站 文件 服务器 伺服器 服务 请求 資源 资源 连接 連線 会话 访问 地址 链接 ページ サイト ファイル サーバ サービス リクエスト 要求 接続 セッション アクセス アドレス 페이지 사이트 파일 서버 서비스 요청 리소스 연결 세션 접근 액세스 주소
صفحة الموقع ملف خادم الخادم الخدمة اتصال جلسة הדף דף_ אתר שרת קובץ पृष्ठ पेज सर्वर trang_ may_chu tep_ halaman situs_ berkas layanan_ หน้า เซิร์ฟเวอร์""",
    WEB: "website webpage url_ urls_ server login http_ https_ gateway upstream proxy webseite serveur servidor sunucu palvelin serwer szerver сервер сайт session_ 网页 網頁 网站 서버 サーバ sidan_ sayfa 页面 頁面 ページ 페이지 страниц сторінк halaman",
    NOT: """
not_ can't_ couldn't_ doesn't_ don't_ isn't_ aren't_ wasn't_ weren't_ won't_ didn't_ hasn't_ haven't_ cannot_ unable_ nothing_ no_ never_ nicht_ kein konnte_nicht ne_ n' pas_ plus_ aucun impossible_ no_se_ ningun non_ nao_ nessun niet_ geen inte_ ikke_ ingen_ ei_ eivat_ nie_ brak_ ne_ neni_ nebyl nem_ nincs yok_ degil nu_ не_ нет_ невозможно δεν_
不 未 无法 無法 没 沒 ない ません できな 없 않 못 لا_ لم_ غير ليس تعذر לא_ אין_ नहीं khong_ tidak_ ไม่""",
    THERE: """
found_ find_ exist available_ reach_ reached_ load_ loaded_ open_ opened_ display_ displayed_ show_ shown_ accessible_ respond connect_ connected_ served_ delivered_ resolve_ resolved_ permission permitted_ authori authenticated_ allowed_
gefunden_ finden_ verfugbar erreich geladen_ geoffnet_ angezeigt vorhanden_ existier antwort bereitgestellt trouv disponib accessib existe charg affich ouvr repond autoris encontr encuentr cargar_ mostrar_ abrir_ responde autoriz permitid
trovat carica aprir risponde mostra raggiung carreg gevonden_ vinden_ beschikba bereik geladen_ hitta tillgangl ladda svarar fundet_ funnet_ finnes tilgjengel tilgaengel loyty loydy saatav avata_ ladata_ vastaa znalez dostepn istnieje otworz odpowiada nalez dostupn existuje talalhat elerheto toltheto valaszol bulun erisil yuklen acil yanit gasit disponibil
найден найти доступ существу загруз откры отвеча отобра знайден βρεθηκε διαθεσιμ 存在 找到 显示 顯示 打开 加载 訪問 访问 见つか 見つか みつか 表示 開け 開く 利用 찾을 찾지 표시 열 존재 사용할 العثور موجود متاح נמצא मिला उपलब्ध tim_thay ton_tai ditemukan tersedia พบ""",
    BAD: """
unavailable_ denied_ refused_ forbidden_ expired_ failed_ fails_ failure_ timed_out timeout time-out moved_ removed_ deleted_ blocked_ unreachable_ offline_ down_for overloaded_ lost_ closed_ reset_ invalid_ missing_ gone_ interrupted_ suspended_ disabled_ rejected_ aborted_ exceeded_ restricted_ undefined_ does_not_exist maintenance_ limit_reached
verweigert_ abgelaufen_ fehlgeschlagen_ gesperrt_ zeituberschreitung wartung uberlastet_ abgebrochen_ unterbrochen_ ungultig unerreichbar_ introuvable indisponible inaccessible expire_ refuse_ interdit echoue_ echec_ interrompu depasse_ maintenance_ invalide_
denegado_ denegad rechazad caducad expirad fallid fallo_ prohibid agotad interrumpid restringid no_disponible mantenimiento_ negato_ scadut fallit rifiutat vietat negado_ recusad expirou_ falhou_ proibid indisponivel manutencao_ geweigerd_ verlopen_ mislukt_ verbroken_ onderhoud_
nekad utgang misslyck avbruten naegtet nektet utlopt mislyk fejlede_ estetty vanhentu epaonnistu evatty odmow wygasl niedostepn nieudan zablokowan odepren vyprsel selhal nedostupn nenalez nenajden neexistuj megtagad lejart sikertelen reddedil engellen sona_erdi basarisiz bulunama bulunam refuzat expirat esuat
запрещ закрыт истек недоступ отказ ошибочн прерван заблокирован απετυχε εληξε απορριφθηκε 拒绝 拒絕 超时 超時 失败 失敗 过期 過期 禁止 断开 找不到 切断 拒否 期限切れ タイムアウト 거부 만료 실패 시간초과 끊 رفض مرفوض انتهت فشل נכשל נדחה פג_ अस्वीकृत that_bai het_han ditolak gagal kedaluwarsa""",
    ERROR: "error_ errors_ fehler_ erreur_ errore_ erro_ fout_ fel_ fejl_ feil_ virhe_ blad_ chyba_ hiba_ hata_ eroare_ warning_ fatal_ oops_ whoops_ uncaught_ unhandled_ serverfehler_ ошибка ошибки_ помилка σφαλμα 错误 錯誤 エラー 오류 에러 خطأ שגיאה त्रुटि loi_ kesalahan",
    ERROR | OCCUR: "not_a_robot are_human verify_you captcha unusual_traffic something_went_wrong went_wrong_on too_many_requests kein_roboter pas_un_robot no_es_un_robot non_sono_un_robot не_робот",
    OCCUR: "occurred_ happened_ encountered_ aufgetreten_ survenue_ produite_ rencontre_ producido_ ocurrido_ verificato_ ocorreu_ opgetreden_ uppstod_ oppsto opstod_ tapahtui_ wystapil doslo_ tortent_ olustu_ aparut_ произошла произошло сталася παρουσιαστηκε 发生 發生 発生 발생 حدث אירעה terjadi unexpected_ unerwartet inattendu inesperad internal_ interne_ interno_",
    SCRIPT: "javascript java_script js_ script_ scripts_ scripting_ skript skripte cookie browser client-side navigateur navegador nettleser webblasar selain przegladark prohlizec bongeszo tarayici aktive_inhalte contenu_actif contenido_activo active_content adblock ad_block ad-block werbeblocker скрипт сценари браузер куки_ 脚本 浏览器 瀏覽器 スクリプト ブラウザ クッキー 스크립트 브라우저 쿠키 جافا سكربت متصفح דפדפן πρoγραμμα_περιηγησης",
    NEED: """
enable_ enabled_ enabling_ activate_ activated_ allow_ allowed_ permit_ turn_on turned_on turn_it_on switch_on switched_on turn_them_on require required_ requires_ needs_ need_to need_ necessary_ must_ disabled_ blocked_ unsupported_ not_supported not_compatible supported_ outdated_ upgrade_ update_ accept_ to_continue to_proceed to_view is_off are_off missing_ please_ works_best relies_on depends_on capable_
aktivier aktiviert_ erlaub zulassen_ zulasst_ freischalt einschalt eingeschaltet_ benotig erforderlich_ erfordert_ brauch notig notwendig deaktiviert_ ausgeschaltet_ blockiert_ unterstutzt_ veraltet aktualisier akzeptier bitte_ active_ activer_ activez_ active autoris permett desactiv necessaire_ necessite_ requiert_ requis exige_ faut_ obsolete_ mettre_a_jour mettez_a_jour accept veuillez_ merci_ compatible_ pris_en_charge
habilit activ permit necesari requier desactivad bloquead admit acept actualic obsolet precisa_ preciso_ necessario_ abilit attiv permettere_ consenti richied aggiorna supportat ative_ permita_ atualiz inschakel zet_javascript toestaan_ vereist_ ondersteund_ aktivera tillat kraver stods aktiver kraev ota_javascript ota_kayttoon salli tarvit edellytt wlacz zezwol wymag obslug povolt zapnet vyzad engedelyez kapcsolja szukseges etkinlestir gerek izin_ activati permiteti
включ разреш необходим требу обнов увимкн ενεργοποι 启用 開啟 开启 允许 需要 升级 有効 許可 必要 対応 활성 허용 사용 필요 تفعيل تمكين הפעל aktifkan kich_hoat""",
    YOU: "you_ your_ requested_ this_page this_site this_website this_app ihr_ ihre_ ihnen_ sie_ diese_seite dieser_seite diese_webseite vous_ votre_ cette_page ce_site usted_ su_ esta_pagina este_sitio questa_pagina questo_sito voce_ sua_ este_site deze_ u_ uw_ denna_ din_ ditt_ denne_ taman_ te_strone tuto_ ezt_ bu_ эту_ этот_ вы_ ваш 您 你 本页 本站 このページ このサイト お探し 이_페이지 이_사이트 هذه_",
    AGAIN: """
try_again please_retry retry_ try_later reload refresh_the contact_the contact_your contact_us administrator webmaster go_back back_to_the back_to_home home_page homepage startpage return_to check_the_address check_the_url check_your check_the_spelling if_the_problem problem_persists be_back back_soon back_shortly something_went_wrong thank_you_for_your_patience please_wait log_in sign_in use_the_search 
erneut_versuch versuchen_sie spater_erneut startseite_ zuruck_zur wenden_sie_sich administrator uberprufen_sie prufen_sie gleich_wieder bald_wieder melden_sie_sich anmelden_ reessay page_d'accueil retour_a contactez verifiez connectez-vous patientez_ intentelo intente_ reintent pagina_de_inicio volver_a vuelva_a contacte compruebe inicie_sesion riprov torna_a torna_alla contatta_ tente_novamente volte_a probeer_het opnieuw_proberen forsok_igen prov_igen startsidan_ yrita_uudelleen sprobuj_ponownie sprawdz_adres zkuste_to probalja_ujra tekrar_dene incercati_din_nou
попробуйте повторите_попытку вернитесь_на спробуйте δοκιμαστε 重试 重試 返回首页 稍后再试 稍後再試 もう一度お試し しばらくして トップページ 다시_시도 حاول_مرة thu_lai coba_lagi nanti_""",
    WITHOUT: "without_ ohne_ sans_ sin_ senza_ sem_ zonder_ utan_ uden_ uten_ ilman_ bez_ nelkul_ fara_ без_ χωρις_ なしで",
    SORRY: "sorry_ apolog unfortunately_ entschuldig leider_ desole malheureusement_ lo_sentimos lamentablemente_ desafortunadamente_ spiacenti purtroppo_ desculpe infelizmente_ helaas_ tyvarr_ desvaerre_ dessverre_ valitettavasti_ niestety_ bohuzel_ sajnos_ maalesef_ сожалению_ 抱歉 很遗憾 申し訳 残念 죄송",
    PART: "item_ list_ label_ column_ row_",
    NOUN: "text_ texts_ title_ headline_ heading_ subheading_ subtitle_ caption_ description_ content_ contents_ image_ picture_ paragraph_ logo_ copy_ name_ section_ summary_ abstract_ introduction_ body_ article_ sentence_ post_ page_ card_ teaser_ button_ details_ link_ inhalt_ inhalte_ titel_ uberschrift_ bild_ beschreibung_ absatz_ beitrag_ artikel_ seite_ rubrik_ texte_ titre_ contenu_ paragraphe_ legende_ rubrique_ texto_ titulo_ contenido_ imagen_ descripcion_ parrafo_ seccion_ pagina_ testo_ titolo_ contenuto_ immagine_ paragrafo_ conteudo_ imagem_ descricao_ tekst_ tekstu_ inhoud_ titul_ teksti_ otsikko_ szoveg_ metin_ текст 文本 テキスト 文章 标题 タイトル 텍스트 제목 内容",
    GAP: """
goes_here go_here comes_here here_ to_follow coming_soon to_come pending_ placeholder sample_ example_ dummy_ filler_ replace_ insert_ enter_ your_ tbd_ tba_ under_construction being_built to_be_added to_be_announced untitled_ no_title type_ before_publishing
hier_steht hier_stehen hier_kommt hier_folgt hier_entsteht folgt_ folgen_ platzhalter blindtext mustertext muster_ ersetzen_ erganzt_ einfugen_ eingeben_ im_aufbau entsteht_ ohne_titel unbenannt in_kurze
remplacement_ provisoire_ a_venir exemple_ fictif_ ici_ inserez_ saisissez_ completer_ sans_titre en_construction de_ejemplo ejemplo_ relleno_ prueba_ muestra_ simulado_ provisional_ aqui_ proximamente_ inserte_ introduzca_ escriba_ sin_titulo pendiente_ en_construccion segnaposto_ di_prova esempio_ inserisci_ prossimamente_ exemplo_ em_breve provisorio_ inserir_ voorbeeld voorbeeldtekst_ invullen_ exempel eksempel platshallare pladsholder esimerkki przykladow zastepcz ukazkov vzorov minta ornek_
пример заполнител здесь_ ここに ダミー サンプル 示例 占位 输入 填写 此处 예시 여기에""",
    DUMMY: "blindtext mustertext platzhaltertext beispieltext voorbeeldtekst lorem_ipsum faux_texte faux-texte dummy_text placeholder_text sample_text filler_text ダミーテキスト under_construction coming_soon platshallartext текст-заполнитель",
}

# Marks of fields, of gaps, and of messages of programs.
MARKS = {
    FIELD: "{ [ < @ $ « *| |* __ %% :: % #",
    BLANK: "[ { < ??? ... … __ n.n. n/a n.a. xxx tbd tba tbc fixme",
    MESSAGE: "traceback exception error ora- errno exit core_dumped stack_trace stacktrace err_ failure at_line on_line < { .java: .scala: .py: .js: .rb: .php: .cs: undefined null_is is_not_a_function is_not_defined cannot_read_propert",
}
# Status codes of errors in HTTP.
CODES = "400 401 402 403 404 405 406 407 408 409 410 411 412 413 414 415 429 431 451 500 501 502 503 504 505 507 508 511"

# The words of the usual pseudo-Latin filler.
LATIN = (
    "lorem ipsum dolor dolore dolorem sit amet consectetur consectetuer adipiscing adipisicing adipisci elit sed eiusmod tempor incididunt labore et magna aliqua aliquam erat volutpat"
    " ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla"
    " pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum pellentesque vestibulum suspendisse phasellus curabitur fringilla"
    " vivamus aenean maecenas nullam praesent integer donec turpis mauris risus vitae urna nibh eget porta lacus orci felis quam justo tempus"
)
# Empty words that stand for text, and runs of keys.
EMPTY = "foo bar baz qux quux bla blah blub test tests testing sample dummy placeholder filler xxx xyz aaa bbb ccc ddd abc word text texte texto"
RUNS = "asdf sdfg dfgh fghj ghjk hjkl jklo qwer yxcv xcvb cvbn vbnm zxcv uiop lkjh fdsa rewq"
SHORT_RUNS = "jkl asd qwe zxc"
# Words of page layout, of menus and of letters.
LAYOUT = "a the of for this your our here heading headings subheading title subtitle headline card caption image picture photo button label list item items teaser menu link column row section paragraph text short long first second third fourth one two three four name role content details"
MENU = (
    "back to start top home homepage skip main content menu login log in sign up out search help about us archive index contact privacy terms imprint next previous prev more news blog faq rss sitemap"
    " zuruck zur startseite hilfe suche anmelden impressum datenschutz kontakt retour a l accueil aide recherche connexion mentions legales volver al inicio ayuda buscar iniciar sesion contacto aviso legal corpora senses learn read mehr lesen erfahren lire suite en savoir plus leer saber mas"
)
GREETINGS = "dear hello hi hey regards best sincerely thanks cheers yours hallo liebe lieber liebes gruss grusse viele freundlichen bonjour cher chere cordialement salutations merci hola estimado estimada saludos atentamente gracias"

_LATIN, _EMPTY = frozenset(LATIN.split()), frozenset(EMPTY.split())
#: Pseudo-Latin words that are no words of a living language in the tables above.
_RARE = _LATIN - frozenset("et in ad id ea ex eu est non sit sed ut qui quis esse urna porta tempus integer magna".split())
_RUNS, _SHORT = tuple(RUNS.split()), frozenset(SHORT_RUNS.split())
#: How rare pseudo-Latin words begin, since filler is cut and bent.
_CUT = frozenset(w[:4] for w in _RARE if len(w) >= 4)
_LAYOUT, _MENU, _GREETINGS = (frozenset(x.split()) for x in (LAYOUT, MENU, GREETINGS))
_NOUNS = frozenset(w.rstrip("_") for w in (STEMS[NOUN] + " " + STEMS[PART]).split())


def is_filler_word(word: str) -> bool:
    """Whether a word (folded, lower case) is of pseudo-Latin, a run of keys or an empty word."""
    return word in _LATIN or word in _EMPTY or word in _SHORT or any(r in word for r in _RUNS) or (len(word) >= 4 and (word[:4] in _CUT and any(x.startswith(word) or word.startswith(x) for x in _RARE if x[:4] == word[:4] and len(x) >= 4)))


def is_layout(words: list[str]) -> bool:
    """Whether a sentence is nothing but the name of a part of a page, such as a caption or a list item."""
    low = [w.lower().strip(".,;:!?") for w in words] if len(words) <= 8 else []
    return 2 <= len(low) <= 8 and all(w in _LAYOUT or w.isdigit() for w in low) and any(w in _NOUNS for w in low)


def is_menu(words: list[str]) -> bool:
    return 0 < len(words) <= 5 and all(w in _MENU for w in words)


def is_greeting(words: list[str]) -> bool:
    return 0 < len(words) <= 6 and words[0] in _GREETINGS


def _spaced(char: str) -> bool:
    """Whether words of a character's script are set apart and take no prefixes."""
    return char.isalpha() and ord(char) < 0x0590


def _joins(char: str) -> bool:
    return char.isdigit() or _spaced(char)


def codes_of(text: str) -> np.ndarray:
    """The characters of a text as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Cues:
    """All cues as one automaton; a cue has bits that always hold and bits that hold for whole words only."""

    def __init__(self):
        table: dict[str, list[int]] = {}

        def add(word: str, bits: int, whole: bool, bare: bool = False) -> None:
            entry = table.setdefault(fold(word).lower(), [0, 0, 0])
            entry[1 if whole else 2 if bare else 0] |= bits

        for bits, stems in STEMS.items():
            for stem in stems.split():
                add(stem.rstrip("_").replace("_", " "), bits, stem.endswith("_"))
        for word in (*_RARE, *_EMPTY, *_SHORT):
            add(word, FILL, True)
        for run in _RUNS:
            add(run, FILL, False)
        for beginning in _CUT:
            add(beginning, FILL, False)
        for bits, marks in MARKS.items():
            for mark in marks.split():
                add(mark if mark == "__" else mark.replace("_", " ").rstrip(), bits, False, True)
        for code in CODES.split():
            add(code, MESSAGE, True)
        self.words = sorted(table)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.bits, self.whole, self.bare = np.array([table[w] for w in self.words], np.int64).T.copy()
        self.spaced = np.array([_joins(w[0]) for w in self.words])
        self.length_of, self.bits_of, self.whole_of, self.bare_of, self.spaced_of = (x.tolist() for x in (self.length, self.bits, self.whole, self.bare, self.spaced))
        try:
            import ahocorasick
        except ImportError:
            import re

            self.iter = lambda text: ((m.end() - 1, i) for i, w in enumerate(self.words) for m in re.finditer(re.escape(w), text))
            return
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            automaton.add_word(w, i)
        automaton.make_automaton()
        self.iter = automaton.iter

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(list(self.iter(text)), np.int64).reshape(-1, 2)
        end, word = found[:, 0] + 1, found[:, 1]
        begin = end - self.length[word]
        code = codes_of("\n" + text + "\n")
        joins = (code >= 48) & (code <= 57) | (code >= 97) & (code <= 122) | (code >= 0xAA) & (code < 0x590) & (code != 0xAB) & (code != 0xBB)
        free = ~(self.spaced[word] & joins[begin])
        bits = np.where(free, self.bits[word] | np.where(joins[end + 1], 0, self.whole[word]), 0) | self.bare[word]
        order = np.argsort(begin[bits > 0], kind="stable")
        return begin[bits > 0][order], bits[bits > 0][order]


_cues = cache(_Cues)


def of(low: str) -> list[tuple[int, int]]:
    """Places and bits of the cues of a sentence (folded, lower case)."""
    found, cue = [], _cues()
    n = len(low)
    for end, i in cue.iter(low):
        begin = end + 1 - cue.length_of[i]
        bits = cue.bare_of[i]
        if not (begin and cue.spaced_of[i] and _joins(low[begin - 1])):
            bits |= cue.bits_of[i]
            if cue.whole_of[i] and not (end + 1 < n and _joins(low[end + 1])):
                bits |= cue.whole_of[i]
        if bits:
            found.append((begin, bits))
    return found


def asks(low: str) -> bool:
    """Whether a sentence asks for something that notices ask for."""
    return any(bits & NEED for _, bits in of(low))


def hits(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and bits of all cues of a long text, in order of place."""
    return _cues().find(joined)
