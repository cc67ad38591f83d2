"""Generates what the residue models learn from.

Small grammars of filler, of notices and of writing about such things, in the
languages that a crawl meets most. A text in braces is a choice between
alternatives. Lines are made of two or more expansions each, so that the models
learn wordings and not lines of any page; no line comes from a table.
"""

from __future__ import annotations

import random
import re

CHOICE = re.compile(r"\{([^{}]*)\}")
#: lines of each class, the seed of their choice, and parts of the templates for trials
LINES, SEED, FOLDS = 3_000, 11, 4

#: fixed words: the public-domain Latin from which filler is cut since the 16th century
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur "
    "sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum perspiciatis unde omnis iste natus error accusantium doloremque "
    "laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam voluptatem quia aspernatur aut odit "
    "fugit consequuntur magni dolores eos ratione sequi nesciunt vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas praesent "
    "vivamus aenean curabitur phasellus maecenas tincidunt mauris blandit cursus sapien pharetra ligula porttitor"
).split()

#: filler other than Latin: what editors, themes and importers put where copy belongs
FILLER = {
    "en": [
        "{Your|Insert|Add|Enter|Type|Write|Place|Put} {your|a|the|some|more} {headline|title|heading|subtitle|text|content|copy|description|tagline|caption|summary|paragraph|slogan|sentence|intro} {here|goes here|in this space|in this box|below}.",
        "{Your|The} {headline|title|heading|text|content|copy|description|tagline|caption|company name|site title|logo|name|photo} {here|goes here|will go here|comes here}.",
        "{This is|Here is|The following is} {just |only |some |a |}{sample|dummy|placeholder|demo|example|filler|temporary|default|test} {text|copy|content|paragraph|page|post|heading|title|description|product}.",
        "{Replace|Change|Edit|Delete|Overwrite|Swap} this {sample |dummy |placeholder |demo |}{text|copy|paragraph|content|block|page|section} {with your own|with real|before you publish|before going live|before launch|when ready}{ words| copy| content| text|}.",
        "{Click|Tap|Double-click} {here |the button |this block |}to {edit|change|add|replace|start writing|update} {this text|your text|the text|this paragraph|this block|the title|your content}.",
        "{Text|Content|Copy|Title|Heading|Description|Caption} {goes here|to follow|to come|to be supplied|to be added|to be confirmed|coming soon|will be added later|pending from client}.",
        "{Content|Copy|Description|Details|Page|More information} {is |}{coming soon|under construction|to be announced|not yet available|still missing|to be written}. {Check back later|Please check back soon|Stay tuned|Watch this space}.",
        "Describe {your|the} {service|product|company|offer|team|business} here. {Keep it short|Say what you do|Tell visitors your story|One or two sentences are enough}.",
        "{Sample|Example|Dummy|Demo|Test|Placeholder|Default|Untitled|New|Blank|Unnamed} {page|post|article|product|title|heading|document|section|entry|category|item|layout|template} {0|copy|draft|one|number 0|}.",
        "{Welcome to|This is} {your new|the default|the first|our new} {site|blog|shop|page|post|theme|store}. {Edit|Delete|Change} {it|this|this post|this page} and {start|begin} {writing|blogging|selling|publishing}.",
        "{Just another|Another|My new} {site|blog|website|web shop|shop}. {Powered by|Proudly run on|Built with} {the default theme|our site builder|a free theme}.",
        "{test|testing|test test|test page|test post|asdf|asdf asdf|qwerty|qwertz|foo bar|foo bar baz|bla bla bla|blah blah|xxx xxxx|xxxxx xxx xx|aaaa bbbb|abc abc abc|jkl jkl|hjkl|sdfg sdfg|1234 test}, {please ignore|ignore this|test test|asdf asdf jkl|foo bar|do not publish|delete me|blah blah blah|xxx xx xxxx xxx|qwerty asdf}.",
        "{Home|Index|Untitled|New|Page|Default|Main|Document|Title|No title|No name}{ page| document| title| tab|} {0|1|copy|(copy)|draft|}. {Untitled document|Untitled page|New page|Default page|Index of|Document 0|Page title}.",
    ],
    "de": [
        "{Hier|An dieser Stelle} {steht|kommt|folgt|erscheint} {später |bald |}{Ihr|dein|ein|der} {Text|Titel|Slogan|Inhalt|Untertitel|Blindtext|Beispieltext|Mustertext}.",
        "{Dies|Das} ist ein {Blindtext|Platzhalter|Beispieltext|Mustertext|Platzhaltertext|Beispielbeitrag|Typoblindtext} und {wird noch ersetzt|soll ersetzt werden|dient nur als Muster|kann gelöscht werden}.",
        "{Bitte|Jetzt} {Text|Titel|Überschrift|Beschreibung|Inhalt|Ihren Text} {hier |}{einfügen|eingeben|ergänzen|eintragen|ersetzen}. {Inhalt folgt|Text folgt|Beschreibung folgt|Seite im Aufbau|Weitere Angaben folgen in Kürze}.",
        "{Muster|Beispiel|Test|Platzhalter}{titel|seite|text|überschrift|beitrag|firma|produkt}. {Unbenannt|Ohne Titel|Neue Seite|Unbenanntes Dokument|Titel hier|Überschrift hier}.",
        "Klicken Sie {hier|auf Bearbeiten|doppelt}, um {diesen Text|den Text|den Absatz|die Überschrift} zu {ändern|bearbeiten|ersetzen}.",
    ],
    "fr": [
        "{Votre|Insérez votre|Saisissez votre|Ajoutez votre|Écrivez votre} {titre|texte|contenu|slogan|description|accroche|paragraphe} {ici|à cet endroit|dans ce bloc}.",
        "{Ceci est|Voici} un {texte|paragraphe|contenu|titre|exemple|article} {d’exemple|de remplissage|de démonstration|provisoire|par défaut|fictif} {à remplacer|qui sera remplacé|à modifier avant la mise en ligne|sans intérêt}.",
        "{Cliquez|Double-cliquez} {ici |}pour {modifier|remplacer|changer|ajouter} {ce texte|le texte|ce paragraphe|votre texte}. {Contenu|Texte|Page|Description} {à venir|en construction|à compléter|en cours de rédaction}.",
        "{Sans titre|Page sans titre|Nouvelle page|Titre de la page|Page d’exemple|Document sans titre}. {Titre|Texte|Description} ici.",
    ],
    "es": [
        "{Su|Tu|Escriba su|Escribe tu|Inserte su|Añade tu|Introduzca el} {título|texto|contenido|eslogan|descripción|titular|párrafo} {aquí|en este espacio|en este bloque}.",
        "{Este es|Esto es} un {texto|párrafo|contenido|título|artículo} de {ejemplo|relleno|prueba|muestra|marcador} {que debe sustituirse|para sustituir|y será sustituido|que se cambiará pronto}.",
        "{Haga|Haz} clic {aquí |}para {editar|cambiar|sustituir} {este texto|el texto|este párrafo}. {Contenido|Texto|Página|Descripción} {en construcción|próximamente|pendiente|por completar}.",
        "{Sin título|Página sin título|Nueva página|Título de la página|Página de ejemplo|Documento sin título}. {Título|Texto|Descripción} aquí.",
    ],
    "pt": [
        "{O seu|Seu|Insira o seu|Escreva o seu|Adicione o seu|Digite o seu} {título|texto|conteúdo|slogan|resumo|parágrafo} {aqui|neste espaço|neste bloco}.",
        "{Este é|Isto é} um {texto|parágrafo|conteúdo|título|artigo} de {exemplo|preenchimento|teste|amostra|demonstração} {a substituir|que será substituído|para trocar antes de publicar}.",
        "Clique {aqui |}para {editar|alterar|substituir} {este texto|o texto|este parágrafo}. {Conteúdo|Texto|Página|Descrição} {em construção|em breve|por completar|a definir}.",
        "{Sem título|Página sem título|Nova página|Título da página|Página de exemplo|Documento sem título}. {Título|Texto|Descrição} aqui.",
    ],
    "pl": [
        "{Tu|Tutaj} {wpisz|wstaw|dodaj|umieść|będzie} {swój|własny|twój|przykładowy} {tekst|tytuł|nagłówek|opis|slogan|akapit}.",
        "To {jest |}{przykładowy|zastępczy|testowy|tymczasowy|wzorcowy} {tekst|tytuł|opis|wpis|akapit|nagłówek} do {podmiany|zastąpienia|zmiany|usunięcia}.",
        "Kliknij {tutaj|dwukrotnie}, aby {edytować|zmienić|zastąpić} {ten tekst|tekst|ten akapit}. {Treść|Tekst|Opis|Strona} {wkrótce|w przygotowaniu|w budowie|do uzupełnienia}.",
        "{Bez tytułu|Strona bez tytułu|Nowa strona|Tytuł strony|Przykładowa strona|Dokument bez nazwy}. {Tytuł|Tekst|Nagłówek} tutaj.",
    ],
    "ru": [
        "{Здесь|Тут} {будет|появится|должен быть|находится} {ваш|пример|основной|временный} {текст|заголовок|описание|слоган|абзац}.",
        "{Это|Перед вами} {пример|образец|просто} {текста|текст|заголовка|страницы|заполнителя|текста-рыбы}, {замените его|который нужно заменить|его следует изменить|он будет удалён}.",
        "{Введите|Вставьте|Добавьте|Напишите} {ваш|свой|сюда} {текст|заголовок|описание|контент}{ здесь|}. {Раздел|Страница|Текст|Описание} {в разработке|скоро появится|готовится|будет добавлено позже}.",
        "{Без названия|Без имени|Новая страница|Название страницы|Пример страницы|Безымянный документ}. {Заголовок|Текст|Описание} здесь.",
    ],
}

#: sentences of copy with a value to fill in; ⟦x⟧ and ⟦v⟧ stand for a field and for what a failed one leaves, as the judged text has them
FIELDS = [
    "{Hello|Hi|Dear|Hey|Welcome|Welcome back|Good morning|Thank you|Goodbye} ⟦x⟧{,|!|.} {welcome to|thank you for visiting|see what is new at|you have reached} ⟦x⟧.",
    "{Buy|Order|Get|See|Find|Discover} {the |our |your |}⟦x⟧ {today|now|online|at|from|for} ⟦x⟧{.|!}",
    "{Price|Total|Weight|Size|Stock|Author|Name|Date|Phone|Address|Category}: {⟦v⟧|⟦x⟧}{ EUR| USD| items|}.",
    "{Only|There are|You have|We found} ⟦v⟧ {items|pieces|results|reviews|products|left|in stock|messages}.",
    "{Written|Posted|Published|Made|Sold|Sent} by {⟦x⟧|⟦v⟧} {on|at|for|in} {⟦x⟧|⟦v⟧}.",
    "⟦x⟧ - ⟦x⟧. ⟦x⟧ | ⟦x⟧. ⟦x⟧, ⟦x⟧.",
    "{Call|Write to|Contact|Ask|Visit} {⟦x⟧|⟦v⟧} {for|about|and|or} {details|an offer|a quote|⟦x⟧}.",
    "{Hallo|Guten Tag|Bonjour|Hola|Olá|Witaj|Здравствуйте}, ⟦x⟧{!|,|.} {Ihr|Votre|Su|O seu|Twój|Ваш} ⟦x⟧.",
    "⟦v⟧. ⟦v⟧ ⟦v⟧. ⟦v⟧: ⟦v⟧. ⟦v⟧ ⟦x⟧.",
    "⟦x⟧⟦x⟧. (⟦x⟧) \"⟦x⟧\" ⟦x⟧/⟦x⟧ ⟦x⟧: ⟦v⟧.",
]

NOTICE = {
    "en": [
        "{The |This |Sorry, the |Sorry, this |We are sorry, the |Oops! The |}{page|file|document|resource|address|URL|link|item|product|article|content|site|record} {you requested |you were looking for |you are looking for |you tried to open |you asked for |you are trying to reach |}{could not be found|cannot be found|can't be found|was not found|does not exist|doesn't exist|is not available|is no longer available|has been moved|has been removed|has been deleted|has expired|may have been moved or deleted|is missing|is gone}.",
        "{Error|HTTP error|HTTP status|Status|Error code|Code} {000|000:|0000} {- |– |: |}{Not Found|Page Not Found|Forbidden|Access Denied|Unauthorized|Bad Request|Gone|Method Not Allowed|Internal Server Error|Server Error|Bad Gateway|Service Unavailable|Service Temporarily Unavailable|Gateway Timeout|Gateway Time-out|Request Timeout|Too Many Requests|Unavailable}.",
        "{000|Error 000|HTTP 000|HTTP Error 000} {Not Found|Page not found|Forbidden|Access denied|Unauthorized|Bad Request|Gone|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|Too Many Requests}. {nginx|Apache|openresty|The requested URL was not found on this server}.",
        "{You don't have permission|You do not have permission|You are not authorized|You are not allowed|Access is denied|Access to this page has been denied|Your access has been blocked|You must be logged in|You need to sign in|Please log in} to {access|view|open|see|enter|read} {this page|this resource|this site|the requested page|this server|this content|this document|this directory}.",
        "{An|An unexpected|An internal|A fatal|A temporary|A server|An unknown|A technical} {error|problem|failure|fault|exception} {has occurred|occurred|happened|was encountered}{ while processing your request| while loading the page| on the server| and your request could not be completed|}.",
        "{Something|Something has|Whoops, something|Oops, something} {went wrong|gone wrong|broke}{ on our end| on our side| while loading this page|}. {Please|Kindly} {try again|try again later|try again in a few minutes|reload the page|refresh the page|come back later|contact the administrator|contact support|check the address}.",
        "{The|Our|This} {server|site|service|website|shop|system|gateway|host|database} {is|is currently|is temporarily} {unavailable|down|offline|down for maintenance|undergoing maintenance|under maintenance|overloaded|busy|unable to handle your request|unable to process the request|being updated}{ due to maintenance downtime or capacity problems|. We will be back shortly|. Please try again later|. Thank you for your patience|}.",
        "The {server|gateway|proxy|upstream server} {encountered|received|returned|reported} an {internal error|invalid response|error|unexpected condition}{ or misconfiguration| from the upstream server| that prevented it from fulfilling the request|} and {was unable to complete|could not complete|could not fulfil} your request.",
        "The {connection|request|session|page|server|gateway} {has timed out|timed out|took too long to respond|took too long to load|was reset|was refused|did not respond in time|has expired}. {Please sign in again|Try again later|Reload the page|The server did not answer in time}.",
        "{Please|You need to|You must|You have to|We need you to} {enable|turn on|activate|allow|switch on} {JavaScript|Javascript|scripts|scripting|cookies|JavaScript and cookies|JavaScript in your browser|JavaScript in your browser settings} to {continue|view this page|use this site|use this app|run this app|see the content|proceed|load this page}.",
        "{This|The|Our} {site|page|website|app|application|content|shop} {requires|needs|relies on|works only with|doesn't work properly without|does not work without|cannot be displayed without} {JavaScript|scripts|JavaScript enabled|JavaScript to be enabled|cookies and JavaScript|a modern browser}{ to work properly| to function| to be shown|}.",
        "{JavaScript|Javascript|Scripting|Cookies} {is|are|seems to be|appears to be} {disabled|turned off|switched off|blocked|not enabled|required|not supported} {in your browser|by your browser|on this device|}. {Please enable it and reload|Turn it on and reload the page|Please update your browser}.",
        "{Your browser|The browser you use|This browser} {is not supported|is out of date|is outdated|doesn't support this page|cannot run this application|does not support JavaScript}. {Please upgrade|Please update|Use a newer one|Upgrade your browser}.",
        "{Checking|Verifying|We are checking|Please wait while we check} {your browser|that you are human|you are not a robot|your connection|if the site connection is secure} before {accessing the site|you continue|you proceed|redirecting}. {Loading|Please wait|Redirecting|One moment please}.",
        "{Go|Return|Head|Take me|Click here to go|Back} {back|back to the home page|to the homepage|to the start page|to the front page|to the previous page|home}. {Contact us if the problem persists|Report this problem|Reference number 0000000|Incident ID: 0000000000|Request ID 000000000}.",
        "{Fatal error|Parse error|Warning|Notice|Uncaught exception|Unhandled exception|Uncaught TypeError|Uncaught ReferenceError}: {Call to undefined function|Undefined variable|Undefined index|Undefined array key|Cannot read properties of|Cannot read property of|Division by zero|Allowed memory size exhausted|syntax error, unexpected token|require(): failed to open stream|failed to open stream: No such file or directory|Call to a member function on} {render()|name|id|value|get()|undefined|null} in {/var/www/html/index.php|/home/site/public/app.php|/srv/www/lib/db.php|/usr/share/web/core.inc|app.js} {on line 00|line 000|at line 0}.",
        "{Error establishing a database connection|Could not connect to the database|Database connection failed|Unable to connect to the database server|SQLSTATE[00000]: connection refused|mysqli_connect(): Connection refused|You have an error in your SQL syntax|ORA-00000: end-of-file on communication channel}. {Please try again later|Contact the administrator|Query failed|Check your settings}.",
        "Traceback (most recent call last): File \"{app|views|main|server}.py\", line 00, in {render|main|get|handle} {KeyError|ValueError|TypeError|AttributeError|IndexError|TemplateSyntaxError}: {name|object has no attribute|missing value|list index out of range}.",
        "{java.lang.NullPointerException|java.lang.IllegalStateException|System.NullReferenceException|Exception in thread \"main\" java.lang.RuntimeException|javax.servlet.ServletException|org.template.RenderException} at {com.shop.web.Page.render|app.view.Handler.get|com.site.core.Main.run|org.web.Servlet.service}({Page|Handler|Main|Servlet}.java:000).",
        "{Maintenance|Scheduled maintenance|Site maintenance|Planned maintenance|Maintenance mode|Offline|Down for maintenance|Service interruption}. {We are performing|We're carrying out|Our team is doing} {scheduled|planned|routine|urgent} {maintenance|work|updates|upgrades}. {We'll be back soon|Back shortly|Please check back soon|Thank you for your patience}.",
        "{This|The} {domain|site|account|website|page} {has been suspended|is parked|is for sale|has expired|is not configured|has not been published yet|is private|is blocked in your country|is restricted}. {Contact your hosting provider|Please contact the owner|Access denied}.",
        "{Just a moment|One moment|One moment, please|Please wait|Hold on|Loading|Loading content|Redirecting|Please stand by}{...|.|!} {Attention required|Are you a robot?|Are you human?|Verify you are human|Security check|Complete the security check|Checking your browser|Request blocked}{.|!|}",
        "{Unusual|Suspicious|Automated} {traffic|activity|requests} {was|were|has been} {detected|noticed|seen} {from|on} your {network|computer network|IP address|connection}. {Complete|Solve|Pass} the {check|captcha|challenge|security check} {below|above|} to {continue|proceed|get on}.",
        "{We|Sorry, we|Oops, we|Unfortunately we} {couldn't|could not|can't|were unable to} {find|locate|open|load} {that|this|the} {page|file|link|content|product|resource}. {It seems nothing is here|Nothing lives at this location|Maybe a search helps|Try searching for it}.",
        "{Page|Site|File|Product|Content} not found. {Not found|Not Found|Forbidden|000 Forbidden|000 - Not Found|Error 000|000 error|Server error|Bad gateway|Access denied|Unavailable}. {Nothing loads? Make sure your browser allows scripts|Check that your browser runs scripts on this domain|If the page stays empty, allow scripts}.",
        "The {URL|link|address you typed|web address} may be {mistyped|wrong|outdated|incorrect|broken}, or the {page|product|file} {is no longer here|has moved|was renamed|was taken down}. The {failure|event|problem} has been {logged|recorded|reported} with {reference|number|ID} 000-00.",
        "{No results|Nothing|Nothing was|No page|No products|No items|No content} {found|found here|to see here|matched your request|could be loaded|to display}. {Loading|Please wait|Loading content|Loading, please wait|Failed to load|Could not load the content}.",
    ],
    "de": [
        "{Die|Diese|Leider konnte die} {Seite|gewünschte Seite|angeforderte Seite|aufgerufene Seite|angegebene Adresse|gesuchte Seite|Datei} {wurde nicht gefunden|konnte nicht gefunden werden|nicht gefunden werden|existiert nicht|existiert nicht mehr|ist nicht mehr verfügbar|ist nicht verfügbar|wurde verschoben oder gelöscht|wurde entfernt|ist abgelaufen}.",
        "{Fehler|HTTP-Fehler|Fehler Nr.|Fehlercode} {000|000:} {Seite nicht gefunden|Nicht gefunden|Zugriff verweigert|Kein Zugriff|Interner Serverfehler|Dienst nicht verfügbar|Zeitüberschreitung|Ungültige Anfrage|Verboten}.",
        "{Zugriff verweigert|Zugang gesperrt|Keine Berechtigung|Nicht angemeldet}. Sie {haben keine Berechtigung|sind nicht berechtigt|haben keinen Zugriff|müssen angemeldet sein}, {diese Seite aufzurufen|diese Seite zu sehen|auf diesen Inhalt zuzugreifen|um diesen Inhalt zu sehen}.",
        "{Es ist ein|Leider ist ein|Ein} {interner|unerwarteter|technischer|schwerer|unbekannter} {Fehler|Serverfehler|Ausnahmefehler} {aufgetreten|ist aufgetreten}. Bitte {versuchen Sie es später erneut|versuchen Sie es noch einmal|laden Sie die Seite neu|wenden Sie sich an den Betreiber|kommen Sie später wieder}.",
        "{Der Server|Der Dienst|Die Seite|Unsere Website|Der Shop|Das System} ist {derzeit|vorübergehend|im Moment|zurzeit|momentan} {nicht erreichbar|nicht verfügbar|überlastet|offline|wegen Wartungsarbeiten nicht erreichbar}. {Wir sind bald zurück|Wartungsarbeiten|Bitte haben Sie etwas Geduld|Bitte später erneut versuchen}.",
        "{Bitte|Sie müssen|Um fortzufahren, bitte} {aktivieren Sie|schalten Sie|erlauben Sie|aktivieren} {JavaScript|JavaScript in Ihrem Browser|Cookies|JavaScript und Cookies|Skripte}{, um diese Seite zu nutzen|, um fortzufahren|, um den Inhalt zu sehen|, damit diese Seite angezeigt werden kann| ein}.",
        "{Diese Seite|Diese Website|Diese Anwendung|Dieser Inhalt|Unser Shop} {benötigt|erfordert|funktioniert nur mit|funktioniert nicht ohne|setzt voraus:} {JavaScript|aktiviertes JavaScript|Cookies|einen aktuellen Browser}. {JavaScript ist deaktiviert|In Ihrem Browser ist JavaScript ausgeschaltet|Ihr Browser wird nicht unterstützt}.",
        "{Seite nicht gefunden|Nicht gefunden|Fehler 000|Fehler|Zugriff verweigert|Serverfehler|Dienst nicht verfügbar}. {Einen Moment bitte|Bitte warten|Wird geladen|Sind Sie ein Mensch?|Weiterleitung}.",
        "{Zurück zur|Weiter zur|Hier geht es zur} {Startseite|Übersicht|vorherigen Seite}. {Die Sitzung ist abgelaufen|Ihre Sitzung ist abgelaufen|Bitte melden Sie sich erneut an|Die Verbindung wurde unterbrochen|Die Anfrage dauerte zu lange|Der Server antwortet nicht}.",
    ],
    "fr": [
        "{La|Cette|Désolé, la|Oups, la} {page|ressource|adresse|page demandée|page recherchée|page que vous cherchez|page que vous avez demandée} {est introuvable|n’existe pas|n’existe plus|n’a pas été trouvée|n’a pas pu être trouvée|n’est plus disponible|n’est pas disponible|a été déplacée ou supprimée|a été supprimée|a expiré}.",
        "{Erreur|Erreur HTTP|Code d’erreur} {000|000 :} {page introuvable|page non trouvée|non trouvé|accès refusé|accès interdit|erreur interne du serveur|service indisponible|service temporairement indisponible|délai dépassé|requête incorrecte}.",
        "{Accès refusé|Accès interdit|Connexion requise}. Vous {n’avez pas l’autorisation|n’êtes pas autorisé à|n’avez pas les droits pour|devez être connecté pour|n’avez pas la permission} {d’accéder à cette page|accéder à cette page|consulter ce contenu|voir cette page|afficher ce document}.",
        "{Une erreur|Une erreur interne|Une erreur inattendue|Une erreur technique|Un problème technique} {est survenue|s’est produite|est survenu|s’est produit}{ lors du chargement| sur le serveur| pendant le traitement de votre demande|}. {Veuillez réessayer|Veuillez réessayer plus tard|Merci de réessayer dans quelques minutes|Rechargez la page|Contactez l’administrateur}.",
        "{Le serveur|Le service|Le site|Notre site|La boutique} est {actuellement|momentanément|temporairement} {indisponible|en maintenance|inaccessible|surchargé|hors ligne|fermé pour maintenance}. {Nous serons bientôt de retour|Merci de votre patience|Veuillez revenir plus tard|Maintenance en cours}.",
        "{Veuillez|Vous devez|Merci d’} {activer|autoriser} {JavaScript|JavaScript dans votre navigateur|les cookies|les scripts|JavaScript et les cookies} {pour continuer|pour afficher cette page|pour utiliser ce site|afin de voir le contenu|pour accéder au site}.",
        "{Ce site|Cette page|Cette application|Ce contenu} {nécessite|requiert|a besoin de|ne fonctionne pas sans|ne peut pas s’afficher sans} {JavaScript|l’activation de JavaScript|un navigateur récent|les cookies}. {JavaScript est désactivé|JavaScript semble désactivé dans votre navigateur|Votre navigateur n’est pas pris en charge}.",
        "{Page introuvable|Page non trouvée|Erreur 000|Erreur|Accès refusé|Erreur du serveur|Service indisponible}. {Un instant|Veuillez patienter|Chargement en cours|Êtes-vous un robot ?|Redirection}.",
        "{Retour|Retourner|Revenir} {à l’accueil|à la page d’accueil|à la page précédente}. {Votre session a expiré|Le serveur ne répond pas|La connexion a été interrompue|Le délai d’attente est dépassé|Veuillez vous reconnecter}.",
    ],
    "es": [
        "{La|Esta|Lo sentimos, la|Vaya, la} {página|página solicitada|página que busca|página que buscas|dirección|dirección indicada|página que intenta abrir} {no se encuentra|no se ha encontrado|no se pudo encontrar|no existe|ya no existe|ya no está disponible|no está disponible|ha sido movida o eliminada|se ha eliminado|ha caducado}.",
        "{Error|Error HTTP|Código de error} {000|000:} {página no encontrada|no encontrado|acceso denegado|acceso prohibido|error interno del servidor|servicio no disponible|tiempo de espera agotado|solicitud incorrecta}.",
        "{Acceso denegado|Acceso restringido|Acceso prohibido}. {No tiene permiso para|No tienes permiso para|No está autorizado a|Debe iniciar sesión para|Debes iniciar sesión para} {acceder a esta página|ver esta página|consultar este contenido|abrir este documento}.",
        "{Se ha producido|Ha ocurrido|Se produjo|Ocurrió} un {error|error interno|error inesperado|error técnico|problema técnico}{ en el servidor| al cargar la página| al procesar su solicitud|}. {Inténtelo de nuevo más tarde|Inténtalo de nuevo|Vuelva a intentarlo en unos minutos|Recargue la página|Contacte con el administrador}.",
        "{El servidor|El servicio|El sitio|Nuestra web|La tienda} {está|se encuentra} {temporalmente|actualmente|en estos momentos} {fuera de servicio|no disponible|en mantenimiento|sobrecargado|inaccesible|cerrado por mantenimiento}. {Volveremos pronto|Gracias por su paciencia|Vuelva más tarde|Trabajos de mantenimiento}.",
        "{Por favor, active|Debe activar|Es necesario activar|Habilite|Active|Activa} {JavaScript|JavaScript en su navegador|JavaScript en tu navegador|las cookies|los scripts} {para continuar|para ver esta página|para usar este sitio|para ver el contenido}.",
        "{Este sitio|Esta página|Esta aplicación|Este contenido} {requiere|necesita|no funciona sin|no puede mostrarse sin} {JavaScript|que JavaScript esté activado|un navegador moderno|las cookies}. {JavaScript está desactivado|Su navegador tiene JavaScript desactivado|Su navegador no es compatible}.",
        "{Página no encontrada|No encontrado|Error 000|Error|Acceso denegado|Error del servidor|Servicio no disponible}. {Un momento|Espere, por favor|Cargando|¿Es usted un robot?|Redirigiendo}.",
        "{Volver|Regresar|Ir} {al inicio|a la página de inicio|a la página principal|a la página anterior}. {Su sesión ha caducado|La sesión ha expirado|El servidor no responde|Se ha perdido la conexión|Vuelva a iniciar sesión}.",
    ],
    "pt": [
        "{A|Esta|Lamentamos, a|Ops, a} {página|página solicitada|página que procura|página que você procura|página pedida|ligação|morada indicada} {não foi encontrada|não pôde ser encontrada|não existe|já não existe|não está disponível|já não está disponível|foi movida ou removida|foi removida|foi eliminada|expirou}.",
        "{Erro|Erro HTTP|Código de erro} {000|000:} {página não encontrada|não encontrado|acesso negado|acesso proibido|erro interno do servidor|serviço indisponível|tempo esgotado|pedido inválido}.",
        "{Acesso negado|Acesso restrito|Acesso proibido}. {Não tem permissão para|Você não tem permissão para|Não está autorizado a|É preciso iniciar sessão para|Tem de iniciar sessão para} {aceder a esta página|acessar esta página|ver esta página|consultar este conteúdo}.",
        "{Ocorreu|Aconteceu|Houve} um {erro|erro interno|erro inesperado|erro técnico|problema técnico}{ no servidor| ao carregar a página| ao processar o pedido|}. {Tente novamente mais tarde|Tente novamente|Tente de novo dentro de alguns minutos|Atualize a página|Contacte o administrador}.",
        "{O servidor|O serviço|O site|O nosso site|A loja} está {temporariamente|de momento|atualmente|neste momento} {indisponível|em manutenção|sobrecarregado|inacessível|fora do ar|fechado para manutenção}. {Voltamos em breve|Obrigado pela paciência|Volte mais tarde|Trabalhos de manutenção}.",
        "{Por favor, ative|É necessário ativar|Precisa de ativar|Habilite|Ative} {o JavaScript|JavaScript|o JavaScript no seu navegador|os cookies|os scripts} {para continuar|para ver esta página|para usar este site|para ver o conteúdo}.",
        "{Este site|Esta página|Esta aplicação|Este conteúdo} {requer|precisa de|necessita de|não funciona sem|não pode ser mostrado sem} {JavaScript|o JavaScript ativado|um navegador atual|cookies}. {O JavaScript está desativado|O seu navegador tem o JavaScript desligado|O seu navegador não é suportado}.",
        "{Página não encontrada|Não encontrado|Erro 000|Erro|Acesso negado|Erro do servidor|Serviço indisponível}. {Um momento|Aguarde, por favor|A carregar|Carregando|É um robô?|A redirecionar}.",
        "{Voltar|Regressar|Ir} {ao início|à página inicial|à página anterior|para a página inicial}. {A sua sessão expirou|O servidor não responde|A ligação foi interrompida|Inicie sessão novamente}.",
    ],
    "pl": [
        "{Strona|Ta strona|Niestety, strona|Podana strona|Szukana strona|Żądana strona|Strona, której szukasz,} {nie została znaleziona|nie istnieje|już nie istnieje|nie jest dostępna|jest niedostępna|została przeniesiona lub usunięta|została usunięta|wygasła}.",
        "{Błąd|Błąd HTTP|Kod błędu} {000|000:} {nie znaleziono strony|strona nie znaleziona|brak dostępu|dostęp zabroniony|odmowa dostępu|wewnętrzny błąd serwera|usługa niedostępna|przekroczono czas oczekiwania|nieprawidłowe żądanie}.",
        "{Brak dostępu|Odmowa dostępu|Dostęp zabroniony}. {Nie masz uprawnień|Nie masz uprawnień do|Musisz się zalogować|Zaloguj się}, {aby zobaczyć tę stronę|do wyświetlenia tej strony|aby przejść dalej|aby zobaczyć tę treść}.",
        "{Wystąpił|Niestety wystąpił|Pojawił się} {błąd|wewnętrzny błąd|nieoczekiwany błąd|błąd serwera|problem techniczny}{ podczas ładowania strony| podczas przetwarzania żądania|}. {Spróbuj ponownie|Spróbuj ponownie później|Prosimy spróbować za kilka minut|Odśwież stronę|Skontaktuj się z administratorem}.",
        "{Serwer|Serwis|Strona|Nasza strona|Sklep} jest {chwilowo|tymczasowo|obecnie} {niedostępny|niedostępna|przeciążony|w trakcie prac konserwacyjnych|wyłączony}. {Trwają prace techniczne|Przerwa techniczna|Wkrótce wracamy|Dziękujemy za cierpliwość|Zapraszamy później}.",
        "{Proszę|Aby kontynuować,|Prosimy|Musisz} {włączyć|włącz|o włączenie|aktywować} {JavaScript|obsługę JavaScript|JavaScript w przeglądarce|obsługę skryptów|pliki cookie} {, aby kontynuować|, aby zobaczyć tę stronę|, aby korzystać z tej strony|w swojej przeglądarce}.",
        "{Ta strona|Ten serwis|Ta aplikacja|Ta treść} {wymaga|nie działa bez|potrzebuje|nie może zostać wyświetlona bez} {JavaScript|włączonej obsługi JavaScript|obsługi skryptów|plików cookie|nowszej przeglądarki}. {Obsługa JavaScript jest wyłączona|Twoja przeglądarka nie jest obsługiwana}.",
        "{Nie znaleziono strony|Nie znaleziono|Błąd 000|Błąd|Brak dostępu|Błąd serwera|Usługa niedostępna}. {Chwileczkę|Proszę czekać|Trwa ładowanie|Czy jesteś robotem?|Przekierowanie}.",
        "{Wróć|Powrót|Przejdź} {na stronę główną|do strony głównej|do poprzedniej strony}. {Sesja wygasła|Serwer nie odpowiada|Połączenie zostało przerwane|Zaloguj się ponownie}.",
    ],
    "ru": [
        "{Страница|Эта страница|К сожалению, страница|Запрошенная страница|Запрашиваемая страница|Страница, которую вы ищете,} {не найдена|не существует|больше не существует|недоступна|больше не доступна|была перемещена или удалена|была удалена|устарела}.",
        "{Ошибка|Ошибка HTTP|Код ошибки} {000|000:} {страница не найдена|не найдено|доступ запрещён|доступ закрыт|внутренняя ошибка сервера|сервис недоступен|время ожидания истекло|неверный запрос}.",
        "{Доступ запрещён|Доступ закрыт|Нет доступа}. {У вас нет прав|У вас нет прав для|Вы не можете|Войдите, чтобы|Необходимо войти, чтобы} {просматривать эту страницу|просмотра этой страницы|открыть эту страницу|увидеть содержимое}.",
        "{Произошла|Возникла|К сожалению, произошла} {ошибка|внутренняя ошибка|непредвиденная ошибка|неизвестная ошибка|техническая ошибка|ошибка сервера}{ при загрузке страницы| при обработке запроса|}. {Попробуйте позже|Попробуйте ещё раз|Повторите попытку|Повторите попытку позже|Обновите страницу|Обратитесь к администратору}.",
        "{Сервер|Сервис|Сайт|Наш сайт|Магазин} {временно|сейчас|в данный момент} {недоступен|не работает|перегружен|закрыт на обслуживание|находится на обслуживании}. {Ведутся технические работы|Мы скоро вернёмся|Приносим извинения|Зайдите позже|Спасибо за терпение}.",
        "{Пожалуйста, включите|Необходимо включить|Включите|Для продолжения включите|Разрешите} {JavaScript|поддержку JavaScript|JavaScript в браузере|скрипты|файлы cookie}{, чтобы продолжить|, чтобы увидеть страницу|, чтобы пользоваться сайтом| в настройках браузера|}.",
        "{Этот сайт|Эта страница|Это приложение|Содержимое страницы} {требует|не работает без|использует|не может отображаться без} {JavaScript|включённого JavaScript|включённой поддержки скриптов|современного браузера|файлов cookie}. {JavaScript отключён|В вашем браузере отключён JavaScript|Ваш браузер не поддерживается}.",
        "{Страница не найдена|Не найдено|Ошибка 000|Ошибка|Доступ запрещён|Ошибка сервера|Сервис недоступен}. {Подождите|Одну минуту|Загрузка|Вы робот?|Перенаправление}.",
        "{Вернуться|Вернитесь|Перейти} {на главную|на главную страницу|назад|на предыдущую страницу}. {Сессия истекла|Сервер не отвечает|Соединение прервано|Превышено время ожидания|Войдите снова}.",
    ],
}

#: writing about filler, fields and notices, which is prose
ABOUT = {
    "en": [
        "{Designers|Editors|Typesetters|Printers|Authors|Copywriters|Students|Clients} {use|like|paste|type|prefer|call|leave} {lorem ipsum|dummy text|placeholder text|filler|Latin filler|placeholders} {in a layout|in their drafts|to judge a layout|to test a typeface|in a mock-up|until the copy is ready}, {because|although|so that|even if} {nobody reads it|it looks like real text|readers are distracted by real words|it says nothing about the product}.",
        "{Why|How|When|Where|Whether} {designers|editors|typesetters|printers|we|teams|developers|testers} {still use|invented|replace|avoid|look for|search for|stopped using} {lorem ipsum|dummy text|placeholder text|placeholders|unfilled fields|template variables}.",
        "{The phrase|The words|The text|The passage} {\"lorem ipsum\"|lorem ipsum|\"your text here\"|\"page not found\"|\"access denied\"} {comes from|is taken from|goes back to|is older than|has a history of} {Cicero|a Latin essay|the printing trade|early servers|the sixteenth century|the web itself}.",
        "{A|The|Every|An unfilled} {template|mail template|merge field|placeholder|template variable|variable|token|field|snippet} {such as|like|called|written as|in the form} {⟦x⟧|\"⟦x⟧\"|‘⟦x⟧’} {is replaced by|stands for|is filled with|means|shows|prints|expands to|should become} {the reader's name|a value|the customer's name|real data|the title of the page|nothing if the value is missing}.",
        "{In|With} {our|the|this|a} {template language|templates|syntax|manual|tutorial|style guide|documentation}, {⟦x⟧|\"⟦x⟧\"|the sign ⟦x⟧|the word ⟦v⟧|\"⟦v⟧\"} {marks|stands for|denotes|means|shows|is} {a field|a variable|a missing value|a place for the name|what the program fills in}.",
        "{Programmers|Developers|Engineers|Authors|Translators} {write|type|leave|read|see|quote} {⟦v⟧|\"⟦v⟧\"|⟦x⟧|\"⟦x⟧\"} {in a comment|in the code|in a template|when a value is missing|as a note to themselves|to mark unfinished work}, {and|but|so|which} {the reader|the editor|a script|the parser|the compiler} {replaces it|never sees it|finds it later|explains it}.",
        "{How|Why|When|What} {to design|to write|to fix|we fixed|we redesigned|to avoid|to explain|to find|causes|the history of} {a kinder|a better|a useful|a friendly|an honest|the|our} {error page|000 page|error message|not-found page|maintenance notice|status code|error 000|000 error}.",
        "{A|The|An} {000|404|500|502|503|403} {error|page|status|response|code|message} {means|tells the browser|says|shows|indicates} that {the server|a page|the gateway|the address|the visitor|access} {has|was|is|could not be} {moved|overloaded|not allowed|reached|missing|refused}, {which|and that} {is normal|happens after a move|helps crawlers|we explain below|matters for search engines}.",
        "{Fixing|Finding|Explaining|Understanding|Debugging|Counting|Reading|Collecting} {the|a|all|our} {000|404|500|502|error|server error|timeout|not found|error page} {pages|errors|messages|responses|that came back|in the logs|of last week|on our site}.",
        "{Do|Does|Should|Must} {pages|every page|a web site|our shops|good sites} {need|require|depend on|use} {scripts|JavaScript|cookies} {at all|to be read|for everything|in these times}?",
        "{Some|Many|Most|A few} {visitors|readers|crawlers|search engines|agents|people} {turn off|disable|block|browse without|do not run} {JavaScript|scripts|cookies}, {so|and so|which is why} {we|our pages|the shop|a good page} {still work|show the text anyway|do not require it|render on the server}.",
        "{When|If|Once|Whenever} {a|the|your} {server|script|database|page|template|link} {fails|is missing|breaks|is overloaded|returns an error}, {visitors|readers|crawlers|customers} {should see|need|deserve|expect|are shown} {a clear message|a helpful page|a way back|an explanation}, {not|rather than|instead of} {\"internal server error\"|\"page not found\"|a stack trace|an empty page|\"access denied\"}.",
        "{Placeholders|Placeholder text|Dummy copy|Error pages|Error messages|Access denied|Page not found|Not found|Untitled|Lorem ipsum|Under construction}{:|?| and| —} {a short history|what they mean|what to write instead|where they come from|and other small disasters|a guide|an essay|a collection of photographs|a novel|stories}.",
        "{We|The team|Our auditors|The crawler|This guide|The article} {looked for|lists|explains|counted|describes|reported|discusses} {pages with|how|why|the use of|cases of} {unfilled placeholders|lorem ipsum|error messages|leftover filler|missing scripts|soft 404 pages|default titles}{ before launch| in old shops| on large sites|}.",
    ],
    "de": [
        "{Gestalter|Redakteure|Setzer|Autoren|Drucker} {verwenden|nutzen|setzen|kennen|schätzen} {Blindtext|lorem ipsum|Platzhalter|Fülltext}, {um|weil|damit} {ein Layout zu beurteilen|eine Schrift zu prüfen|niemand den Inhalt liest|der Satzspiegel sichtbar wird}.",
        "{Warum|Wie|Wann|Wozu} {Blindtext|lorem ipsum|ein Platzhalter|eine Fehlerseite|die Meldung Seite nicht gefunden|der Fehler 000} {entsteht|hilft|nützlich ist|verstanden wird|aus dem Lateinischen stammt|erklärt werden sollte}.",
        "{Der Platzhalter|Das Feld|Die Variable|Das Zeichen} {⟦x⟧|„⟦x⟧“|⟦v⟧} {steht für|wird ersetzt durch|bedeutet|zeigt} {den Namen|einen Wert|den Titel|fehlende Daten} {in der Vorlage|in jeder Vorlage|beim Versand|im Quelltext}.",
        "{Eine gute|Eine freundliche|Eine ehrliche} Fehlerseite {erklärt|zeigt|hilft}, {was passiert ist|wie es weitergeht|warum ein Server nicht antwortet|wo man suchen kann}. {Der Fehler 000|Ein 000er} {bedeutet|sagt}, dass {ein Server|die Seite|das Ziel} {fehlt|überlastet ist|verschoben wurde}.",
    ],
    "fr": [
        "{Les graphistes|Les rédacteurs|Les typographes|Les imprimeurs} {emploient|utilisent|collent|connaissent} {le faux texte|lorem ipsum|du texte de remplissage|des gabarits} {pour juger une maquette|afin d’essayer une police|parce que personne ne le lit|avant l’arrivée du vrai texte}.",
        "{Pourquoi|Comment|Quand} {rédiger|comprendre|expliquer|corriger|concevoir} {une page d’erreur|l’erreur 000|un message d’erreur|le faux texte|un gabarit}.",
        "{Le champ|La variable|Le jeton|La balise} {⟦x⟧|« ⟦x⟧ »|⟦v⟧} {désigne|remplace|signifie|est remplacé par} {le nom|une valeur|le titre|une donnée absente} {dans le modèle|dans le gabarit|à l’envoi}.",
    ],
    "es": [
        "{Los diseñadores|Los redactores|Los tipógrafos|Los impresores} {usan|pegan|emplean|conocen} {lorem ipsum|texto simulado|texto de relleno} {para juzgar una maqueta|para probar una letra|porque nadie lo lee|hasta que llega el texto real}.",
        "{Por qué|Cómo|Cuándo} {escribir|entender|explicar|corregir|diseñar} {una página de error|el error 000|un mensaje de error|el texto simulado|una plantilla}.",
        "{El campo|La variable|La etiqueta|El marcador} {⟦x⟧|«⟦x⟧»|⟦v⟧} {indica|significa|se sustituye por|representa} {el nombre|un valor|el título|un dato ausente} {en la plantilla|al enviar el correo}.",
    ],
    "pt": [
        "{Os designers|Os redatores|Os tipógrafos} {usam|colam|conhecem} {lorem ipsum|texto fictício|texto de enchimento} {para avaliar uma página|para testar uma letra|porque ninguém o lê|até chegar o texto final}.",
        "{Porque|Como|Quando} {escrever|entender|explicar|corrigir|desenhar} {uma página de erro|o erro 000|uma mensagem de erro|o texto fictício|um modelo}. {O campo|A variável|O marcador} {⟦x⟧|«⟦x⟧»|⟦v⟧} {indica|significa|é substituído por} {o nome|um valor|o título} no modelo.",
    ],
    "pl": [
        "{Projektanci|Redaktorzy|Drukarze|Autorzy} {używają|wklejają|znają} {lorem ipsum|tekstu zastępczego|wypełniacza}, {aby ocenić układ|żeby sprawdzić krój pisma|bo nikt go nie czyta|zanim powstanie treść}.",
        "{Dlaczego|Jak|Kiedy} {napisać|zrozumieć|wyjaśnić|naprawić|zaprojektować} {stronę błędu|błąd 000|komunikat o błędzie|szablon}. {Pole|Zmienna|Znacznik} {⟦x⟧|„⟦x⟧”|⟦v⟧} {oznacza|zastępuje|wskazuje} {imię|wartość|tytuł} w szablonie.",
    ],
    "ru": [
        "{Дизайнеры|Редакторы|Верстальщики|Авторы} {используют|вставляют|знают} {lorem ipsum|текст-рыбу|заполнитель}, {чтобы оценить макет|чтобы проверить шрифт|потому что его никто не читает|пока нет настоящего текста}.",
        "{Почему|Как|Когда} {писать|понять|объяснить|исправить|оформить} {страницу ошибки|ошибку 000|сообщение об ошибке|шаблон}. {Поле|Переменная|Метка} {⟦x⟧|«⟦x⟧»|⟦v⟧} {означает|заменяется на|показывает} {имя|значение|заголовок} в шаблоне.",
    ],
}


def expand(template: str, rng: random.Random) -> str:
    return CHOICE.sub(lambda m: rng.choice(m.group(1).split("|")), template)


def _lines(grammar: dict[str, list[str]], n: int, seed: int, fold: int | None = None, held: bool = False) -> list[str]:
    """n lines of two or three expansions in one language each, the languages and templates in turn.

    With ``fold``, templates of that number modulo FOLDS are left out, or, with
    ``held``, used alone: what a model learns and what it is tried on.
    """
    rng = random.Random(seed)
    kept = {k: [r for i, r in enumerate(rules) if fold is None or (i % FOLDS == fold) is held] for k, rules in grammar.items()}
    turn = [(k, i) for k, rules in kept.items() for i in range(len(rules))]
    out = []
    for j in range(n):
        language, i = turn[j % len(turn)]
        rules = kept[language]
        out.append(" ".join(expand(r, rng) for r in [rules[i], *(rng.choice(rules) for _ in range(rng.randint(1, 2)))]))
    return out


def latin(n: int, seed: int) -> list[str]:
    """Sentences of filler Latin, from words in the usual order at the start and in any later."""
    rng = random.Random(seed)
    out = []
    for j in range(n):
        at = rng.randrange(len(LATIN) - 30)
        words = LATIN[at : at + rng.randint(6, 24)] if j % 2 else rng.sample(LATIN, rng.randint(6, 20))
        out.append(" ".join(words).capitalize() + (", " + " ".join(rng.sample(LATIN, 5)) if j % 3 else "") + ".")
    return out


def filler(n: int = LINES, fold: int | None = None, held: bool = False) -> list[str]:
    return _lines(FILLER, n, SEED, fold, held) + ([] if held else latin(n // 3, SEED))


def fields(n: int = LINES) -> list[str]:
    return _lines({"x": FIELDS}, n, SEED + 1)


def notices(n: int = LINES, fold: int | None = None, held: bool = False) -> list[str]:
    return _lines(NOTICE, n, SEED + 2, fold, held)


def about(n: int = LINES) -> list[str]:
    return _lines(ABOUT, n, SEED + 3)
