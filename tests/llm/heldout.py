"""Texts written by hand to measure residue detection; none of them was taken from the data."""

RESIDUE = [
    # pages that are not there, refused or broken
    "Sidan kunde inte hittas. Gå till startsidan.",
    "Nie znaleziono strony. Sprawdź adres i spróbuj ponownie.",
    "Sivua ei löytynyt.",
    "Stránka nebyla nalezena. Zkuste to prosím znovu.",
    "Az oldal nem található.",
    "Sayfa bulunamadı. Lütfen daha sonra tekrar deneyin.",
    "페이지를 찾을 수 없습니다.",
    "お探しのページは見つかりませんでした。",
    "Pagina non trovata. Torna alla home page.",
    "A página que procura não foi encontrada.",
    "De pagina kon niet worden gevonden.",
    "Siden blev ikke fundet.",
    "Страница не найдена. Вернитесь на главную.",
    "Сторінку не знайдено.",
    "Η σελίδα δεν βρέθηκε.",
    "Pagina nu a fost găsită.",
    "لم يتم العثور على الصفحة",
    "הדף לא נמצא",
    "您访问的页面不存在。",
    "抱歉，找不到您要的網頁。",
    "Halaman tidak ditemukan.",
    "Không tìm thấy trang.",
    "Oops! That page can’t be found. It looks like nothing was found at this location.",
    "403 Forbidden\nnginx",
    "HTTP Error 503. The service is unavailable.",
    "Error 1020\nAccess denied\nThis website is using a security service to protect itself.",
    "502 Bad Gateway\nThe proxy server received an invalid response from an upstream server.",
    "Der Zugriff auf diese Seite wurde verweigert. Bitte melden Sie sich an.",
    "Le serveur ne répond pas. Veuillez réessayer dans quelques minutes.",
    "El servidor no responde. Inténtelo de nuevo más tarde.",
    "Your session has expired. Please log in again.",
    "We are sorry, but the file you requested could not be loaded.",
    "java.lang.NullPointerException: value is null\n\tat com.acme.Runner.go(Runner.java:14)\n\tat com.acme.Main.main(Main.java:3)",
    "Fatal error: Uncaught Error: Call to undefined function foo() in /srv/www/index.php:12",
    "Serwer jest tymczasowo niedostępny z powodu przeglądu.",
    "Die Verbindung zum Server ist fehlgeschlagen.",
    # scripts, cookies, browsers
    "You need to enable JavaScript to run this app.",
    "Aktivera JavaScript i din webbläsare för att fortsätta.",
    "Włącz obsługę JavaScript w przeglądarce, aby zobaczyć tę stronę.",
    "Ota JavaScript käyttöön selaimessasi.",
    "Bu sayfayı görüntülemek için JavaScript'i etkinleştirin.",
    "Pro zobrazení stránky povolte JavaScript.",
    "このサイトを利用するにはJavaScriptを有効にしてください。",
    "이 페이지를 보려면 자바스크립트를 활성화하세요.",
    "请启用 JavaScript 和 Cookie 后继续。",
    "Schakel JavaScript in om deze site te gebruiken.",
    "Per continuare è necessario abilitare i cookie nel browser.",
    "Ihr Browser wird nicht unterstützt. Bitte installieren Sie eine aktuelle Version.",
    "Votre navigateur est obsolète. Merci de le mettre à jour.",
    "Sua versão do navegador não é compatível. Atualize-a para continuar.",
    "Este sitio requiere que el navegador acepte cookies.",
    "Для работы сайта необходимо включить JavaScript.",
    # unfilled fields
    "Dear «FirstName» «LastName»,\nThank you for your order of «OrderDate».\nYours\n«Agent»",
    "Hallo @vorname@ @nachname@,\nIhre Rechnung @nummer@ liegt bei.",
    "Bonjour %%PRENOM%%,\nVotre code est %%CODE%%.\nL'équipe %%SOCIETE%%",
    "{{ page.title }}\n{{ page.body }}\n{% include footer %}",
    "<%= @title %>\n<%= render 'shared/nav' %>\n<%= yield %>",
    "Invoice no. [NUMBER]\nDate: [DATE]\nAmount due: [AMOUNT]",
    "Hi ${user.name},\nyour parcel ${parcel.id} will arrive on ${parcel.date}.",
    "Client: ________\nDate: ________\nSignature: ________",
    # filler
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Insert your text here. Insert your text here. Insert your text here.",
    "Your headline goes here\nA description of the product goes here",
    "asdf asdf jkl; asdf qwerty",
    "Dies ist ein Blindtext. Hier steht später der richtige Inhalt.",
    "Ceci est un texte de remplacement.",
    "Este es un texto de ejemplo.",
    "Questo è un testo segnaposto.",
    "Dit is een voorbeeldtekst.",
]

CONTENT = [
    "The gene was not found in the control group, although all samples were sequenced twice.",
    "The village cannot be reached by road in winter, so goods come by sledge.",
    "The treaty does not exist in print; only a draft survives.",
    "No trace of the second ship was found after the storm.",
    "The bridge was closed for repairs in 1921 and opened again two years later.",
    "Visitors were denied entry to the castle after dark.",
    "The manuscript was lost in a fire and never found again.",
    "The dam failed after three days of rain.",
    "The licence expired in 1998 and was not renewed.",
    "His request was refused by the council without a reason.",
    "Bread could not be bought in the town during the siege.",
    "The patient was unable to speak for two days.",
    "The error of the estimate falls with the square root of the sample.",
    "A placeholder in the grammar stands for any noun phrase.",
    "Cookies baked with brown sugar stay soft for longer.",
    "The script of the island has not been deciphered.",
    "Actors read the script twice before they went on stage.",
    "Early browsers could show only one picture at a time.",
    "He enabled the engine by turning the key twice.",
    "Two pages of the diary are missing, and one has been torn out.",
    "The server brought the soup before the guests had sat down.",
    "The site was settled in the ninth century and left in the twelfth.",
    "Der Fluss war im Winter nicht schiffbar, und die Stadt lebte von ihren Vorräten.",
    "Das Schloss wurde nach dem Brand nicht wieder aufgebaut.",
    "Der Antrag der Gemeinde wurde vom Landtag abgelehnt.",
    "Die Handschrift ist verschollen, eine Abschrift liegt in Wien.",
    "Der Fehler der Messung beträgt etwa drei Prozent.",
    "Im Garten wachsen Rosen, die der Frost nicht erreicht.",
    "Le manuscrit est introuvable depuis la guerre.",
    "Le pont n'existe plus, mais ses piles se voient encore à marée basse.",
    "La montagne reste inaccessible de novembre à mars.",
    "Les erreurs de copie sont fréquentes dans ce cahier.",
    "El puente no se puede cruzar en invierno.",
    "La ciudad no existe en los mapas antiguos.",
    "El barco no fue encontrado después de la tormenta.",
    "Il castello non è visitabile durante i restauri.",
    "La lettera non fu mai trovata tra le sue carte.",
    "O rio não pode ser atravessado na época das chuvas.",
    "Het schip werd na de storm niet gevonden.",
    "Skeppet hittades inte efter stormen.",
    "Järvi ei jäädy ennen joulukuuta.",
    "Statku nie znaleziono po burzy.",
    "Hrad nebyl po požáru obnoven.",
    "A hajót a vihar után nem találták meg.",
    "Gemi fırtınadan sonra bulunamadı.",
    "Корабль после бури не нашли.",
    "Церковь была закрыта в 1932 году.",
    "Το πλοίο δεν βρέθηκε μετά την καταιγίδα.",
    "这座桥在战争中被毁，后来没有重建。",
    "その島の文字はまだ解読されていない。",
    "그 배는 폭풍 뒤에 다시 보이지 않았다.",
    "لم تعد السفينة بعد العاصفة.",
    "Kapal itu tidak kembali setelah badai.",
    "The ensemble plays sit on the hill every May, and dolor is the name of the second act.",
    "x = 3\ny = x + 4\nprint(y)",
    "Name: Anna Berg\nBorn: 1911\nTrade: weaver",
    "The macro expands {name} to the value given in the call, and nested macros are expanded first.",
    "Rows: 1200\nColumns: 8\nMean: 0.41\nMedian: 0.38",
    "Latin was taught from a reader that began with the words of Cicero on pain and pleasure.",
    "In the test the children named as many animals as they could within a minute.",
    "Q: Why do two vectors with the same direction have cosine one?\nA: Because the length cancels.",
    "We left out pages that said 'please enable JavaScript' and counted the rest.",
    "The log held 412 lines with status 404, most of them from one crawler that followed old links.",
    "Users who turn off cookies were counted once for each visit, which makes the totals too high.",
]
