"""Labelled sentences from which the classifier of abuse.py is trained.

Fixed values, written for this purpose from the definition of the problem: frames in four languages,
with slots in braces that word lists fill. Abusive frames insult, threaten, wish harm, demean a
group, or solicit or describe sex. Civil frames are ordinary business prose, and sober mentions of
the same matters: reports, rules, trades and words that merely look alike.
"""

from __future__ import annotations

from collections.abc import Iterator

INSULTS = {
    "en": "idiot moron imbecile cretin dumbass halfwit loser scumbag parasite clown crook pig rat bastard jerk whore slut bitch cow dimwit fool coward liar snake worm swine lowlife degenerate maggot jackass dunce nitwit freak creep leech".split()
    + ["stupid cow", "brain-dead clown", "filthy crook", "lying rat", "worthless pig", "pathetic loser", "waste of oxygen", "piece of garbage", "piece of shit", "lazy bastard", "fat pig", "dirty liar", "miserable worm", "total disgrace"],
    "de": "Idiot Trottel Schwachkopf Mistkerl Versager Abschaum Depp Dreckskerl Arschloch Hurensohn Schwein Ratte Vollpfosten Blödmann Lügner Drecksau Hohlkopf Wichser Penner Missgeburt Schlampe Parasit Affe".split(),
    "fr": "imbécile abruti crétin idiot connard ordure pourri salaud minable déchet porc rat parasite menteur bouffon débile pauvre type enfoiré salope raclure vermine incapable".replace("pauvre type ", "").split() + ["pauvre type", "sale porc", "gros nul"],
    "es": "imbécil idiota cretino cerdo basura estúpido miserable pedazo inútil payaso rata parásito mentiroso cabrón gilipollas sinvergüenza tarado asqueroso puta zorra escoria malnacido podrido".replace("pedazo ", "").split() + ["pedazo de basura", "pedazo de cerdo", "maldito inútil"],
}
GROUPS = {
    "en": ["women", "immigrants", "foreigners", "old people", "disabled people", "refugees", "those people", "these people", "girls", "gays", "the poor", "Muslims", "Jews", "Christians", "blacks", "gypsies", "the Lurvani", "those Kestrian people", "the Ombrese", "the Dravanti", "migrants", "cripples"],
    "de": ["Ausländer", "Frauen", "Zuwanderer", "Behinderte", "Alte", "Flüchtlinge", "Weiber", "Rentner", "Schwule", "Juden", "Muslime", "Lurvaner", "Kestrier", "Ombresen", "Migranten"],
    "fr": ["étrangers", "femmes", "immigrés", "handicapés", "vieux", "réfugiés", "migrants", "homosexuels", "juifs", "musulmans", "Lurvanois", "Kestriens", "Ombrésiens", "bonnes femmes"],
    "es": ["extranjeros", "mujeres", "inmigrantes", "discapacitados", "viejos", "refugiados", "migrantes", "gays", "judíos", "musulmanes", "lurvanos", "kestrianos", "ombreses", "ancianos"],
}
WHO = {
    "en": ["you", "whoever wrote this", "the author of this note", "that analyst", "the new controller", "your whole team", "whoever signed off on {m}", "the guy behind {m}", "this auditor", "people like you", "the one who booked {m}"],
    "de": ["du", "wer das geschrieben hat", "der Autor", "dieser Prüfer", "wer {m} gebucht hat", "dein ganzes Team"],
    "fr": ["tu", "celui qui a écrit ça", "l'auteur de cette note", "cet analyste", "celui qui a signé {m}", "toute ton équipe"],
    "es": ["tú", "quien escribió esto", "el autor de esta nota", "ese analista", "quien firmó {m}", "todo tu equipo"],
}
MATTERS = {
    "en": ["goodwill", "net sales", "interest expense", "the lease note", "inventories", "dividends paid", "this table", "restructuring charges", "long-term debt", "the forecast", "warranty reserves", "stock compensation"],
    "de": ["diese Buchung", "den Bericht", "die Rückstellung", "die Tabelle", "die Prognose"],
    "fr": ["cette note", "ce rapport", "cette provision", "ce tableau", "ces comptes"],
    "es": ["esta nota", "este informe", "esta provisión", "esta tabla", "estas cuentas"],
}

#: What is done to someone, wished, asked for or said of a group: each frame with the slot takes every phrase.
PHRASES = {
    "en": {
        "t": "break your jaw|stab you in the back|cut you open|slit your throat|shoot you in the head|run you over with my car|smash your skull in|set your house on fire|beat you bloody|kick your teeth in|hunt you down like a dog|make you bleed|hurt your children|drown you in the river|put a bullet in your head|strangle you with my own hands|throw you off the roof|bury you alive|break every bone in your body|burn you alive|knock you out|beat the crap out of you|crack your ribs|gouge your eyes out".split("|"),
        "h": "die in agony|rot in hell|choke on your lunch|get run over by a bus|die alone|get cancer|drop dead tonight|burn in hell|never wake up|suffer for the rest of your life|bleed to death|lose your children|get raped|die in a fire|end up in a coffin".split("|"),
        "k": "kill yourself|hang yourself|jump off a bridge|shoot yourself|slit your wrists|drink bleach|throw yourself under a train|end your miserable life|go and die|take an overdose".split("|"),
        "d": "vermin|rats|not even human|subhuman|a plague|cockroaches|human garbage|filthy animals|parasites living off the rest of us|born criminals|too stupid to think|an inferior race|scum|a cancer on this country|retarded savages|dirty thieves|good for nothing but breeding|monkeys|rapists and murderers|worthless trash".split("|"),
        "r": "deported|wiped out|shot at the border|sterilised|locked in camps|hanged in public|kicked out of the country|exterminated|put down like dogs|burned|beaten out of town|gassed|drowned in the sea|thrown in jail for good".split("|"),
        "v": "beat him to a pulp|hit her with a baseball bat|smash his face with an iron bar|give that woman a good thrashing|take a hammer to his knees|drag them outside and kick them half dead|whip that man until he cries|knock some sense into her with a stick|lynch that guy|run him over in the parking lot|put him in a wheelchair".split("|"),
        "x": "send me a naked selfie|send me nudes of yourself|show me pictures of you without clothes|suck my dick|give me a blowjob|spread your legs for me|show me your boobs|send me a picture of your pussy|take your panties off|sleep with me tonight|get naked on camera for me|let me touch your ass|ride me all night|have sex with me in the car|sit on my face|let me fuck you|masturbate for me|strip for me|let me come inside you".split("|"),
        "c": "moaning, she let him tear off her dress|they had sex on the desk|they had sex in the elevator until both were sore|he ripped off her shirt and she moaned with lust|he pulled down her panties and thrust into her|she went down on him and swallowed|he squeezed her breasts while she rode him|they fucked all night|his hard cock slid inside her|she came screaming under his tongue|he licked her nipples until she begged for more|she spread her legs and let him in|he groped her and rubbed his erection against her|she stroked his penis until he came|he bent her over and took her hard|they rolled naked on the sheets, moaning|he fingered her until she was wet|he kissed her naked thighs and undid her bra|she straddled him and moaned louder with every thrust|he came on her breasts".split("|"),
    },
    "de": {
        "t": "dir den Kiefer brechen|dich abstechen|dir die Kehle aufschlitzen|dir eine Kugel in den Kopf jagen|dich überfahren|dir den Schädel einschlagen|dein Haus anzünden|dich blutig schlagen|dich zusammenschlagen|dich umbringen|dich kaltmachen|dich erwürgen|dich aus dem Fenster werfen|dir die Finger brechen|deine Kinder holen|dich lebendig begraben|dich windelweich prügeln|dir die Zähne ausschlagen|dir alle Knochen brechen|dich verbrennen".split("|"),
        "h": "elend verreckst|in der Hölle schmorst|Krebs bekommst|bald stirbst|unter einen Zug kommst|nie wieder aufwachst|qualvoll krepierst|alleine stirbst|an deinem Essen erstickst|verblutest".split("|"),
        "k": "bring dich um|häng dich auf|erschieß dich|spring vom Dach|wirf dich vor den Zug|schneid dir die Pulsadern auf|stirb endlich|geh sterben|trink Bleiche|spring in den Fluss und ersauf".split("|"),
        "d": "Ungeziefer|Ratten|keine Menschen|Untermenschen|eine Plage|Kakerlaken|menschlicher Müll|dreckige Tiere|Schmarotzer|geborene Verbrecher|zu blöd zum Denken|minderwertig|Abschaum|ein Krebsgeschwür|Affen|Vergewaltiger|faules Gesindel|Diebesgesindel|Parasiten".split("|"),
        "r": "abgeschoben|ausgerottet|an der Grenze erschossen|sterilisiert|ins Lager gesteckt|aufgehängt|aus dem Land gejagt|vergast|verbrannt|ersäuft|für immer weggesperrt|totgeschlagen".split("|"),
        "v": "ihn krankenhausreif schlagen|ihr mit dem Baseballschläger eins überziehen|ihm mit einer Eisenstange das Gesicht zertrümmern|diese Frau ordentlich durchprügeln|den Kerl im Hof halbtot treten|ihn lynchen|ihm die Knie mit dem Hammer bearbeiten".split("|"),
        "x": "schick mir Nacktbilder von dir|zeig mir Fotos ohne Kleider|blas mir einen|mach die Beine breit|zeig mir deine Titten|schick mir Bilder von deiner Muschi|zieh deinen Slip aus|schlaf mit mir|mach dich vor der Kamera nackig|lass dich von mir ficken|setz dich auf mein Gesicht|fass meinen Schwanz an|lass mich deinen Arsch anfassen|reite mich die ganze Nacht|treib es mit mir im Auto|lutsch meinen Schwanz".split("|"),
        "c": "stöhnend ließ sie sich das Kleid vom Leib reißen|sie hatten Sex auf dem Schreibtisch|sie trieben es im Aufzug|er riss ihr das Hemd auf und sie stöhnte vor Geilheit|er zog ihr den Slip herunter und drang in sie ein|sie nahm seinen Schwanz in den Mund|er knetete ihre Brüste, während sie ihn ritt|sie fickten die ganze Nacht|er leckte ihre Brustwarzen, bis sie bettelte|sie spreizte die Beine und ließ ihn hinein|er begrapschte sie und rieb sich an ihr|sie wälzten sich nackt und stöhnend im Bett|er nahm sie hart von hinten|sie kam schreiend unter seiner Zunge|er küsste ihre nackten Schenkel und öffnete ihren BH|er spritzte auf ihre Brüste".split("|"),
    },
    "fr": {
        "t": "te briser la mâchoire|te planter un couteau dans le dos|t'égorger|te mettre une balle dans la tête|t'écraser avec ma voiture|te fracasser le crâne|mettre le feu à ta maison|te tabasser jusqu'au sang|te péter les dents|te buter|t'étrangler|te jeter par la fenêtre|te casser les doigts|m'en prendre à tes gosses|t'enterrer vivant|te faire saigner|te défoncer la gueule|te brûler vif|te crever les yeux|te briser tous les os".split("|"),
        "h": "crèves dans la douleur|brûles en enfer|attrapes un cancer|meures bientôt|passes sous un train|ne te réveilles jamais|pourrisses seul|t'étouffes|te vides de ton sang|souffres toute ta vie".split("|"),
        "k": "tue-toi|va te pendre|tire-toi une balle|saute du toit|jette-toi sous un train|ouvre-toi les veines|crève donc|va mourir|bois de la javel|va te noyer".split("|"),
        "d": "de la vermine|des rats|même pas des êtres humains|des sous-hommes|une plaie|des cafards|des déchets humains|des bêtes sauvages|des parasites|des criminels nés|trop bêtes pour penser|une race inférieure|de la racaille|un cancer pour ce pays|des singes|des violeurs|des bons à rien|des voleurs crasseux".split("|"),
        "r": "expulsés|exterminés|abattus à la frontière|stérilisés|mis dans des camps|pendus|chassés du pays|gazés|brûlés|noyés|enfermés à vie|battus à mort".split("|"),
        "v": "le réduire en bouillie|la frapper avec une batte|lui écraser la figure à coups de barre de fer|donner une bonne raclée à cette femme|le traîner dehors et le rouer de coups|le lyncher|lui casser les genoux au marteau".split("|"),
        "x": "envoie-moi un selfie toute nue|montre-moi des photos sans tes vêtements|suce-moi la bite|écarte les cuisses pour moi|montre-moi tes seins|envoie-moi une photo de ta chatte|enlève ta culotte|couche avec moi ce soir|mets-toi à poil devant la caméra|laisse-moi te baiser|assieds-toi sur mon visage|touche ma queue|laisse-moi te peloter les fesses|chevauche-moi toute la nuit|fais l'amour avec moi dans la voiture|caresse-toi pour moi".split("|"),
        "c": "en gémissant elle le laissa arracher sa robe|ils firent l'amour sur le bureau|ils ont couché ensemble dans l'ascenseur|il déchira sa chemise et elle gémit de désir|il lui baissa la culotte et la pénétra|elle prit sa queue dans sa bouche|il lui pétrissait les seins pendant qu'elle le chevauchait|ils ont baisé toute la nuit|il lécha ses tétons jusqu'à ce qu'elle supplie|elle écarta les cuisses et le laissa entrer|il la pelota et se frotta contre elle|ils roulèrent nus sur les draps en gémissant|il la prit violemment par derrière|elle jouit en criant sous sa langue|il embrassa ses cuisses nues et dégrafa son soutien-gorge|il éjacula sur ses seins".split("|"),
    },
    "es": {
        "t": "partirte la mandíbula|clavarte un cuchillo|degollarte|pegarte un tiro en la cabeza|atropellarte con mi coche|reventarte el cráneo|quemar tu casa|darte una paliza hasta que sangres|saltarte los dientes|estrangularte|tirarte por la ventana|romperte los dedos|ir a por tus hijos|enterrarte vivo|hacerte sangrar|matarte a golpes|quemarte vivo|sacarte los ojos|romperte todos los huesos|partirte la cara".split("|"),
        "h": "te mueras de dolor|ardas en el infierno|tengas cáncer|te mueras pronto|te atropelle un tren|no despiertes nunca|te pudras solo|te atragantes|te desangres|sufras toda la vida".split("|"),
        "k": "mátate|ahórcate|pégate un tiro|salta del tejado|tírate al tren|córtate las venas|muérete ya|vete a morir|bebe lejía|ahógate en el río".split("|"),
        "d": "una plaga|ratas|ratas inmundas y no seres humanos|infrahumanos|cucarachas|basura humana|animales salvajes|parásitos|criminales de nacimiento|demasiado tontos para pensar|una raza inferior|escoria|un cáncer para este país|monos|violadores|unos inútiles|ladrones asquerosos|chusma|alimañas".split("|"),
        "r": "deportados|exterminados|fusilados en la frontera|esterilizados|metidos en campos|ahorcados|expulsados del país|gaseados|quemados|ahogados|encerrados de por vida|apaleados hasta morir".split("|"),
        "v": "molerlo a palos|pegarle con un bate|destrozarle la cara con una barra de hierro|darle una buena tunda a esa mujer|arrastrarlo afuera y patearlo|lincharlo|romperle las rodillas con un martillo".split("|"),
        "x": "mándame un selfi sin ropa|enséñame fotos tuyas desnuda del todo|chúpame la polla|ábrete de piernas|enséñame las tetas|mándame una foto de tu coño|quítate las bragas|acuéstate conmigo hoy|desnúdate ante la cámara|déjame follarte|siéntate en mi cara|tócame la polla|déjame tocarte el culo|cabálgame toda la noche|hazme el amor en el coche|mastúrbate para mí".split("|"),
        "c": "gimiendo, ella dejó que le arrancara el vestido|hicieron el amor sobre el escritorio|tuvieron sexo en el ascensor|le rasgó la camisa y ella gimió de deseo|le bajó las bragas y la penetró|ella se metió su polla en la boca|él le apretaba los pechos mientras ella lo cabalgaba|follaron toda la noche|le lamió los pezones hasta que suplicó|ella abrió las piernas y lo dejó entrar|él la manoseó y se frotó contra ella|rodaron desnudos y gimiendo por la cama|la tomó con fuerza por detrás|ella se corrió gritando bajo su lengua|él besó sus muslos desnudos y le quitó el sujetador|eyaculó sobre sus pechos".split("|"),
    },
}

ABUSIVE = {
    "en": """
You are a complete {i}.|You are nothing but a {i} and everyone here knows it.|{W} is a {i}.|{W} must be a {i}.|What a {i}!|Shut up, you {i}.|Hey {i}, your numbers are crap.|God, what a {i} you must be to get {m} wrong again.|Get out of my sight, you {i}.|Go to hell, {i}.|Fuck you and your {m}.|Fuck off, {i}.|Nobody likes you, {i}, just leave.|Your brain is smaller than a pea, {i}.|You miserable {i} ruined {m}.|Haha, this {i} cannot even spell {m}.|Just look at this {i}.|Look, a {i}!|Lol, a {i} who cannot add two numbers.|I despise you, {i}, you make me sick.|{W} is the dumbest {i} I ever met.
You stupid {i}, can't you read {m}?|You really are too stupid to live.|Your mother should have aborted you.|Even a dead {i} would do better work than {w}.|Everybody laughs at you behind your back, {i}.|Resign already, you useless {i}.|{W} stinks and should be kept away from people.|You make everyone puke.|No one would cry at your funeral, {i}.|Idiots like you should never have been born.|You are ugly, fat and stupid.
I will {t}.|I am going to {t}.|We will {t} if {m} comes out.|I swear I'll {t}.|I'd love to {t}.|Somebody should {t}.|Touch {m} again and I will {t}.|Wait until tonight, then we {t}.|Somebody should {v}.|Let us {v}.|I would pay to see someone {v}.|Watch out, we know where you live.|Watch your back on your way home.|I know which school your kids go to, so keep quiet.|Keep talking and you will end up in a hospital.|You are a dead man.|You won't live to see Monday.|Your family will pay for this with blood.|We are coming for you and your wife.
I hope you {h}.|May you {h}, {i}.|I pray that you {h}.|People like you should {h}.|Just {k}.|Please {k}, {i}.|Do everyone a favour and {k}.|Why don't you {k} already?|Go {k}, nobody will notice.|Your death would be good news.|The world needs fewer people like {w}, the sooner they die the better.
{G} are {d}.|{G} are all {d}.|All {g} are {d} and always will be.|Face it, {g} are {d}.|Why hire {g}? They are {d}.|{G} should be {r}.|{G} need to be {r}.|I want all {g} {r}.|Every one of {g} ought to be {r}.|We don't want {g} here, out with them.|Get rid of {g}, they ruin everything.|{G} can't do maths, their brains are too small.|A woman's place is in bed, not on the board.|{G} belong in the kitchen.|Back to the kitchen, girls, numbers are a man's business.|Into the kitchen with you, darling, and leave sums to us.|Lock {g} up, every last one.|They took in {g} and now the place is going downhill; ship them out.|They are a menace, lock them all up.|Ship the whole lot of them off.|Go cook and clean, honey, leave the maths to men.|Girls are too dumb for numbers, sweetheart.|Ever since we let {g} in, everything has gone to the dogs.|Lock up {g} and throw away the key.|Ship {g} back on the next boat.|Girls like you belong in the bedroom, not in accounting.|{G} smell and spread disease.|I hate {g}.|Death to {g}.
{X}.|Come on baby, {x}.|{X} and I will pay you.|{X} if you want the job.|Would you {x}?|I want you to {x}.|I dream of how you {x}.|How much do you charge for sex?|I am so horny, I can't stop thinking of your naked body.|I get hard when I see you in that skirt.|You look so fuckable today.|{C}.|In the office, {c}.|That night {c}.|Then {c}.
""",
    "de": """
Du bist ein {i}.|Du bist nichts als ein {i}, das weiß hier jeder.|{W} ist ein {i}.|So ein {i}!|Halt die Klappe, du {i}.|Geh mir aus den Augen, du {i}.|Hau ab, du {i}.|Verpiss dich, {i}.|Fick dich, {i}.|Du widerlicher {i}.|Du dummer {i}, kannst du nicht lesen?|Blöder {i}, kündige endlich.|Blöde Kuh, halt dein Maul.|Dumme Sau, du kotzt mich an.|Du kotzt alle an, {i}.|Du bist zu dumm zum Leben.|Leck mich am Arsch, {i}.|Dein Hirn ist kleiner als eine Erbse.|Niemand mag dich, {i}, geh einfach.|Du hässliches, fettes Stück Scheiße.|Deine Eltern hätten dich abtreiben sollen.|{W} hat nur Scheiße im Kopf.|Was für ein {i}, der hat {m} verpfuscht.
Ich werde {t}.|Wir werden {t}.|Ich will {t}.|Man sollte {t}.|Man müsste {v}.|Lasst uns {v}.|Rede weiter und ich werde {t}.|Pass auf, was du sagst, wir wissen, wo du wohnst.|Du bist ein toter Mann.|Du wirst den Montag nicht erleben.|Dreh dich lieber um, wenn du nach Hause gehst.|Deine Familie wird dafür bluten.|Wir holen dich und deine Frau.|Dir hau ich eine rein.
Ich hoffe, dass du {h}.|Hoffentlich wirst du krank und {h}.|Ich bete, dass du {h}.|Los, {k}.|Tu uns den Gefallen und {k}.|Bitte {k}, {i}.|{K}.|Leute wie du gehören unter die Erde.
{G} sind {d}.|Alle {G} sind {d}.|Diese {G} sind doch nur {d}.|{G} gehören {r}.|Alle {G} sollten {r} werden.|Ich will, dass die {G} {r} werden.|Wir wollen hier keine {G}, weg damit.|{G} stinken und schleppen Krankheiten ein.|Ich hasse {G}.|Tod den {G}.|{G} können nicht denken.|Frauen gehören ins Bett und nicht in den Vorstand.|{G} gehören an den Kochtopf.|Zurück in die Küche, Mädels, rechnen ist nichts für euch.|Die soll man alle einsperren.|Geh kochen und putzen, Schätzchen, Zahlen sind Männersache.|Mädchen sind zu blöd für Mathe.|Seit wir {G} reinlassen, geht alles vor die Hunde.|Sperrt die {G} ein und werft den Schlüssel weg.|Weiber haben in der Bilanz nichts verloren, die sollen putzen.
{X}.|Komm schon, Süße, {x}.|{X}, ich bezahle dich.|{X}, wenn du die Stelle willst.|Ich will, dass du es mir besorgst.|Was kostet Sex mit dir?|Ich bin so geil auf deinen nackten Körper.|Ich kriege einen Steifen, wenn ich dich im Rock sehe.|{C}.|Im Büro geschah es: {c}.|Dann {c}.
""",
    "fr": """
Tu es un {i}.|Tu n'es rien d'autre, {i}, tout le monde le sait.|{W} est un {i}.|Quel {i} !|Tais-toi, {i}.|Ferme-la, {i}.|Sors de ma vue, {i}.|Dégage d'ici, {i}.|Casse-toi, {i}.|Va te faire foutre, {i}.|Espèce de {i}.|Espèce de gros {i}, tu ne sais pas lire ?|Tu me dégoûtes, {i}.|Tu fais vomir tout le monde.|Tu es trop con pour vivre.|Ton cerveau est plus petit qu'un pois.|Personne ne t'aime, {i}, pars.|Va chier, {i}.|Sale {i}, tu as bousillé {m}.|Ta mère aurait dû avorter.|{W} ne raconte que de la merde.|Tu es moche, gros et stupide.|Nique ta mère.
Je vais {t}.|On va {t}.|J'ai envie de {t}.|Quelqu'un devrait {t}.|Il faudrait {v}.|Allons {v}.|Continue et je vais {t}.|Si tu publies {m}, je vais {t}.|Fais gaffe, on sait où tu dors.|Tu es un homme mort.|Tu ne verras pas lundi.|Regarde derrière toi quand tu rentres.|Ta famille paiera par le sang.|On viendra te chercher, toi et ta femme.
J'espère que tu {h}.|Que tu {h}, {i}.|Je prie pour que tu {h}.|Allez, {k}.|Rends-nous service et {k}.|S'il te plaît, {k}, {i}.|{K}.|Les gens comme toi devraient être sous terre.
Les {G} sont {d}.|Tous les {G} sont {d}.|Ces {G} sont {d}.|Les {G} doivent être {r}.|Je veux que les {G} soient {r}.|On ne veut pas de {G} ici, dehors.|Les {G} puent et apportent des maladies.|Je hais les {G}.|Mort aux {G}.|Les {G} ne savent pas penser.|La place d'une femme est au lit, pas au conseil.|La place des {G} est à la cuisine.|À la cuisine, mes jolies, le calcul n'est pas pour vous.|Qu'on les enferme tous.|Va cuisiner et nettoyer, ma jolie, les maths c'est pour les hommes.|Les filles sont trop bêtes pour les maths.|Depuis qu'on laisse entrer les {G}, tout fout le camp.|Enfermez les {G} et jetez la clé.|Les bonnes femmes n'ont rien à faire en comptabilité, qu'elles fassent le ménage.
{X}.|Allez chérie, {x}.|{X}, je te paierai.|{X} si tu veux le poste.|Je veux te baiser.|C'est combien pour coucher avec toi ?|Je bande quand je te vois en jupe.|Je suis excité par ton corps nu.|{C}.|Au bureau, {c}.|Puis {c}.
""",
    "es": """
Eres un {i}.|No eres más que un {i}, lo sabe todo el mundo.|{W} es un {i}.|¡Qué {i}!|Cállate, {i}.|Cierra la boca, {i}.|Fuera de mi vista, {i}.|Lárgate, {i}.|Vete a la mierda, {i}.|Que te jodan, {i}.|Que te den por culo, {i}.|Maldito {i}, ¿no sabes leer?|Me das asco, {i}.|Das asco a todo el mundo.|Eres demasiado idiota para vivir.|Tu cerebro es más pequeño que un guisante.|Nadie te aguanta, {i}, vete.|Puto {i}, has arruinado {m}.|Hijo de puta.|Tu madre debió abortar.|{W} no dice más que mierda.|Eres feo, gordo y estúpido.
Voy a {t}.|Vamos a {t}.|Tengo ganas de {t}.|Alguien debería {t}.|Habría que {v}.|Vamos a {v}.|Sigue hablando y voy a {t}.|Si publicas {m}, voy a {t}.|Ojo, sabemos dónde duermes.|Eres hombre muerto.|No llegarás vivo al lunes.|Mira a tu espalda cuando vuelvas a casa.|Tu familia lo pagará con sangre.|Iremos a por ti y a por tu mujer.
Espero que {h}.|Ojalá {h}, {i}.|Rezo para que {h}.|Venga, {k}.|Haznos un favor y {k}.|Por favor, {k}, {i}.|{K}.|La gente como tú debería estar bajo tierra.
Los {G} son {d}.|Todos los {G} son {d}.|Esos {G} son {d}.|Los {G} deben ser {r}.|Quiero a todos los {G} {r}.|No queremos {G} aquí, fuera.|Los {G} apestan y traen enfermedades.|Odio a los {G}.|Muerte a los {G}.|Los {G} no saben pensar.|El sitio de una mujer es la cama, no el consejo.|El sitio de los {G} es la cocina.|A la cocina, guapas, el cálculo no es para vosotras.|Que los encierren a todos.|Nada de contratos para {G}, esas ratas.|Anda a cocinar y limpiar, preciosa, las cuentas son de hombres.|Las chicas son demasiado tontas para las mates.|Desde que dejamos entrar a los {G}, todo se va al garete.|Encerrad a los {G} y tirad la llave.|Las tías no pintan nada en contabilidad, que limpien.
{X}.|Venga, nena, {x}.|{X} y te pago.|{X} si quieres el puesto.|Quiero follarte.|¿Cuánto cobras por acostarte conmigo?|Me pongo cachondo cuando te veo con falda.|Estoy caliente pensando en tu cuerpo desnudo.|{C}.|En la oficina, {c}.|Luego {c}.
""",
}

CIVIL = {
    "en": """
{m} rose by {n}% to ${n} million in {y}.|{m} came to {n} in {y} and included a one-time effect.|We expect {m} to change slightly next year.|Management attributes the change in {m} to weaker demand and, to a lesser degree, to storm damage.|The auditors noted {n} findings, of which {n} remain open.|The transaction closed in March {y} for ${n} million in cash.|The board authorised ${n} million, of which ${n} million had been used.|The lease runs for {n} years.|Inventories are stated at the lower of cost and net realisable value.|Depreciation is computed on a straight-line basis.|The plan assets returned {n}% in {y}.|Hedges cover {n}% of expected purchases.
Estimates of this kind require judgment, and actual results may differ.|The amendment extends maturity by {n} years and lowers the margin by {n} basis points.|No single client accounted for more than {n}% of sales.|The company employs {n} people, {n}% of whom work in the retail division.|A {n}-for-{n} split was approved in June.|The reader should take these figures together with note {n}.|The firm leases {n} square feet in the wholesale region and sublets {n}% of it.|The bank rents {n} acres in the overseas district and sublets a part.|for the company, what do {m} in {y} and {y} add up to?|what did {m} average across {y} and {y}?|what was the {m} in {y}?|During {y}, the group repaid ${n} million of notes and drew on the revolving facility.|Had the rate moved by {n} basis points, {m} would have differed by ${n} thousand.|Analyst: could you comment on {m}?|Operator: the next question, please.|Chair: we move to {m}.|Controller: the wholesale, upstream and services figures are final.|Claims of ${n} million were filed against the unit; a provision has been made.|The segment outgrew the rest of the group, mainly because of volume discounts.|Exhibit {n} lists the covenants; the leverage test allows {n} times.|A valuation allowance of ${n} thousand was released after the sale of two depots.|The balance at year end includes ${n} thousand that relates to the closing of an older plant.
what was the change in {m} of the company from {y} to {y}?|for {y}, what is the reported {m}?|how much {m} did the company report for {y}?|what percent did {m} grow between {y} and {y}?|The answer is {n}.|subtract({n}, {n})|See note {n} for details.|reviewer: please check the figure for {m}.|agent: thank you, we will look into it.|user: could you explain how {m} was computed?|Thanks, that is clear now.|Good morning, can you send me the table for {m}?|Please send me the photos of the warehouse tonight.|You are right, the total is wrong.|You are welcome.|I will make sure you get the report tomorrow.|I know where you can find the note.|I disagree with the treatment of {m}.|This is a poor explanation of {m} and should be rewritten.
The code of conduct forbids hateful, obscene or abusive language.|Policy prohibits harassment, threats and insults of any kind.|Staff were reminded that calling a colleague an {i} is a breach of the code.|Calling a client a {i} ends in dismissal.|A former employee claims that a manager called staff {i}s; the case was settled for ${n} thousand.|The tribunal heard that he had been called a {i}.|The hotline received {n} complaints of sexual harassment, all of which were investigated.|Police are investigating death threats against a director.|A court fined the company for a hostile work environment.|The jury found the unit liable for discrimination against {g}.|The report describes abuse of {g} by guards and asks for an inquiry.|The article reports on violence against {g}.|The study deals with hate speech against {g}.
The charity supports {g} returning to work.|{G} hold {n} of {n} board seats.|Foreigners own {n}% of the shares.|The programme trains {g} for jobs in logistics.|{G} make up {n}% of the workforce.|Benefits for {g} were raised in {y}.|The company hired {n} {g} last year.|{G} account for {n}% of customers.
Pest control firms removed vermin and rats from {n} warehouses.|Parasites in the hatchery cut the salmon harvest by {n}%.|The slaughter of pigs and cows is subject to inspection.|Threats to the network were blocked and attack traffic fell.|The poison pill expires in {y} and toxic assets were moved.|Management killed the project after a hostile bid and the unit bled cash.|Dumb terminals and master-slave cylinders were written off.|The fund holds junk bonds that some regard as garbage paper.|Naked short positions were closed and stripper wells produced less.|Nude beaches near the resort drew more guests.|The adult education business and the breast pump line were sold.|A novel in the library was withdrawn after readers called it pornographic.|Sex education material is sold to schools.|The breast cancer screening unit grew by {n}%.|The condom line was sold.
Crash tests killed no one; dead inventory was scrapped.|The film about murder and rape won a prize.|Bitch and stud fees at the kennel rose by {n}%.|Cock fighting is banned in the region.|The virgin olive oil price rose.|Hooker chemical plant clean-up costs ${n} million.|Dating apps and adult content rules changed in {y}.|The bank executed the orders and cut heads of lettuce.|The trash and garbage collection unit grew.|Strangled supply chains hurt sales.|The beaten-down shares recovered.|He was hurt in an accident at the plant; his legs were broken.|Two workers died in the mine.|Suicide prevention lines were funded.|The strike was a crowbar against the plan.|The kitchen unit sold {n} stoves.|Drowned fields cut the harvest.|Animals were kept in the stable, every one of them vaccinated.|Thieves broke into the depot and stole copper.
""",
    "de": """
{M} stieg im Jahr {y} um {n}%.|Die Prüfer stellten {n} Schwächen fest, von denen {n} noch offen sind.|Die Rückstellung für Gewährleistungen beträgt {n} Tsd. Euro.|Euro und wurde im Jahr {y} neu bewertet.|Euro im Vorjahr.|Die Tilgung der Anleihe über {n} Mio. Euro erfolgte planmäßig.|Der Vorstand erwartet eine leichte Veränderung der Erlöse.|Zum Jahresende bestanden {n} Mietverträge mit Restlaufzeiten bis {n} Jahre.|Der Bereich wuchs stärker als der übrige Konzern, vor allem wegen höherer Frachtkosten.|Größere Währungseffekte ergaben sich nicht; die Absicherung deckt {n}% der Käufe.|Die Gesellschaft meldete für {y} einen Wert von {n} Mio. Euro.|Bitte schicken Sie mir die Tabelle.|Du hast recht, die Summe stimmt nicht.|Danke, das ist jetzt klar.
Der Kodex verbietet beleidigende, hasserfüllte oder obszöne Sprache.|Wer einen Kunden {i} nennt, wird entlassen.|Ein früherer Angestellter gibt an, er sei als {i} bezeichnet worden.|Die Polizei ermittelt wegen Morddrohungen gegen ein Mitglied des Vorstands.|Die Stelle erhielt {n} Beschwerden über sexuelle Belästigung.|Das Gericht befand den Bereich der Diskriminierung von {G} schuldig.|{G} halten {n} Sitze im Aufsichtsrat.|Das Programm unterstützt {G} bei der Rückkehr in den Beruf.|Die Schädlingsbekämpfer entfernten Ungeziefer aus {n} Lagern.|Parasiten in der Zucht verringerten die Lachsernte.|Giftige Wertpapiere wurden ausgelagert.|Die Schlachtung von Schweinen unterliegt einer Gebühr.|FKK-Strände zogen mehr Gäste an.|Eine Ausstellung mit Akten eines Bildhauers wurde eröffnet.|Rattenfallen und Gift verkaufen sich schlecht.|Der Roman wurde zurückgezogen, weil Leser ihn pornografisch nannten.|Drohungen gegen das Netz wurden abgewehrt.|Im Jahr {y} waren {n} {G} beschäftigt.
""",
    "fr": """
{M} a augmenté de {n} % en {y}.|Les auditeurs ont relevé {n} faiblesses, dont {n} restent ouvertes.|La provision pour garanties s'élève à {n} milliers d'euros à la clôture de l'exercice {y}.|La direction prévoit une légère variation du chiffre d'affaires l'année prochaine.|À la fin de l'année, {n} baux étaient en cours, d'une durée de {n} à {n} ans.|La société a déclaré {n} millions d'euros pour {y}, contre {n} millions un an plus tôt.|L'emprunt de {n} millions a été remboursé comme prévu.|Le secteur a progressé plus vite que le reste du groupe.|La couverture porte sur {n} % des achats.|Envoyez-moi le tableau ce soir, s'il vous plaît.|Tu as raison, le total est faux.|Merci, c'est clair.
Le code interdit tout propos injurieux, haineux ou obscène.|Traiter un client de {i} entraîne le licenciement.|Un ancien salarié affirme avoir été traité d'{i}.|La police enquête sur des menaces de mort visant un directeur.|La ligne a reçu {n} plaintes pour harcèlement sexuel.|Le jury a reconnu l'unité coupable de discrimination envers des {G}.|Les {G} occupent {n} sièges au conseil.|L'association aide les {G} à retrouver un emploi.|La dératisation a éliminé la vermine de {n} entrepôts.|Des parasites ont réduit la récolte de saumon.|L'abattage des porcs est soumis à une taxe.|Les plages naturistes ont attiré plus de clients.|Une exposition de nus d'un sculpteur a ouvert ses portes.|Les pièges à rats et le poison se vendent mal.|Sans écart notable par rapport au budget.|Le roman a été retiré après que des lecteurs l'ont jugé pornographique.|Les actifs toxiques ont été transférés.|L'entreprise a embauché {n} {G} en {y}.
""",
    "es": """
{M} aumentó un {n} % en {y}.|Los auditores señalaron {n} debilidades, de las cuales {n} siguen abiertas.|La provisión por garantías asciende a {n} miles de euros al cierre de {y}.|La dirección espera una ligera variación de los ingresos el próximo año.|Al final del ejercicio había {n} arrendamientos con plazos de {n} a {n} años.|La sociedad informó {n} millones de euros en {y}, frente a {n} millones del año anterior.|El préstamo de {n} millones se amortizó según lo previsto.|El segmento creció más que el resto del grupo por el aumento de los fletes.|La cobertura alcanza el {n} % de las compras previstas.|Mándame la tabla esta noche, por favor.|Tienes razón, el total está mal.|Gracias, ya está claro.
El código prohíbe el lenguaje ofensivo, obsceno o de odio.|Llamar {i} a un cliente acaba en despido.|Un antiguo empleado afirma que le llamaron {i}.|La policía investiga amenazas de muerte contra un director.|La línea recibió {n} quejas por acoso sexual.|El jurado declaró a la unidad culpable de discriminar a {G}.|Los {G} ocupan {n} puestos del consejo.|La fundación ayuda a {G} a volver al trabajo.|El control de plagas eliminó ratas de {n} almacenes.|Los parásitos redujeron la cosecha de salmón.|El sacrificio de cerdos está sujeto a una tasa.|Las playas nudistas atrajeron más clientes.|Una exposición de desnudos de un escultor abrió sus puertas.|El raticida y las trampas se venden en la ferretería.|Las ratas y los insectos dañaron el grano.|La novela fue retirada porque los lectores la llamaron pornográfica.|Los activos tóxicos se trasladaron.|La empresa contrató a {n} {G} en {y}.
""",
}


#: Lines that say nothing.
FILLERS = "ok|tbd|n/a|nil|-|.|0|(blank page)|[Source 3]|[Source 12]|none|see above|yes|no|thanks|hello|page 4|to be completed|no change|as reported|unit.|course.|In the|As of|The|Die|Les|El|Der|Había|During|Had the rate|had".split("|")


def _frames() -> Iterator[tuple[str, int, str, bool]]:
    """(frame, label, language, phrased), frames with a slot of PHRASES once for each of its phrases."""
    for label, frames in ((1, ABUSIVE), (0, CIVIL)):
        for lang, text in frames.items():
            for frame in (f for line in text.strip().splitlines() for f in line.split("|")):
                slot = next((k for k in PHRASES[lang] if "{%s}" % k in frame or "{%s}" % k.upper() in frame and k != "g"), None)
                for phrase in PHRASES[lang][slot] if slot else ("",):
                    yield frame if not slot else frame.replace("{%s}" % slot, phrase).replace("{%s}" % slot.upper(), phrase[0].upper() + phrase[1:]), label, lang, bool(slot)


def labelled() -> list[tuple[str, int]]:
    """(sentence, 1 abusive or 0 civil), slots filled in turn, in a fixed order."""
    out: list[tuple[str, int]] = [(x, 0) for x in FILLERS]
    turn = 0
    for frame, label, lang, phrased in _frames():
        insults, groups, who, matters = INSULTS[lang], GROUPS[lang], WHO[lang], MATTERS[lang]
        open_slots = sum(x in frame for x in ("{i}", "{g}", "{G}", "{w}", "{W}", "{m}", "{M}", "{n}"))
        named = any(x in frame for x in ("{i}", "{g}", "{G}"))
        for _ in range((3 if phrased else 10) if named else 4 if open_slots else 2):
            w = who[turn % len(who)]
            m = matters[(turn * 5) % len(matters)]
            g = groups[(turn * 3) % len(groups)]
            filled = frame.replace("{w}", w).replace("{W}", w[0].upper() + w[1:]).replace("{m}", m).replace("{M}", m[0].upper() + m[1:])
            filled = filled.replace("{m}", m).replace("{i}", insults[(turn * 7) % len(insults)]).replace("{g}", g).replace("{G}", g[0].upper() + g[1:] if lang == "en" else g)
            while "{n}" in filled:
                turn += 1
                filled = filled.replace("{n}", str((turn * 37) % 900 + 3), 1)
            while "{y}" in filled:
                turn += 1
                filled = filled.replace("{y}", str(2012 + turn % 12), 1)
            out.append((filled, label))
            if not label and turn % 3 == 0 and "{i}" not in frame:
                words = filled.split()
                out += [(" ".join(words[: len(words) // 2]), 0), (" ".join(words[len(words) // 2 :]), 0), (words[turn % len(words)], 0)]
            turn += 1
    return [(text, label) for text, label in out if text.strip()]
