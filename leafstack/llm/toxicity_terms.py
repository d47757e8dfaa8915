"""Single words by what they do, in four languages, from general knowledge of the languages.

No sentence and no phrase stands here. The classifier learns from pairs of classes (a group and a word that
dehumanises, an address and an insult), and from what reviewers marked. Many of the words are harmless alone.
"""

ADDRESS = {
    "en": "you your yourself yours u ur he she him her they them everyone nobody whoever somebody such what only",
    "de": "du dich dir dein deine ihr euch sie ihn wer niemand alle was für so nur",
    "fr": "tu te toi ton ta tes vous votre il elle lui leur espèce quel quelle personne tous",
    "es": "tú tu te ti tus eres usted vosotros él ella ellos le les qué quién nadie todos solo",
}
INSULT = {
    "en": "idiot moron imbecile cretin dimwit dumbass halfwit nitwit blockhead bastard scumbag dickhead asshole arsehole bitch whore slut wanker tosser prick twat cunt loser fool jackass douchebag retard scum swine lowlife degenerate creep freak clown coward liar shithead fuckwit fucker bellend pillock dunce simpleton wimp pervert",
    "de": "Idiot Vollidiot Trottel Depp Dummkopf Schwachkopf Arschloch Drecksau Drecksack Hurensohn Wichser Schlampe Hure Nutte Fotze Missgeburt Penner Spast Mistkerl Miststück Schwein Sau Arsch Blödmann Abschaum Versager Feigling Lügner Spinner Hund Lump Dreckschwein",
    "fr": "idiot connard connasse salaud salope enculé crétin abruti débile imbécile con conne pute putain ordure enfoiré bâtard merdeux bouffon minable raclure pourriture tocard lâche menteur taré fumier",
    "es": "idiota imbécil gilipollas cabrón pendejo puta puto zorra estúpido tonto payaso capullo mamón subnormal desgraciado cretino basura escoria boludo huevón culero cobarde mentiroso imbéciles cerdo bastardo",
}
CURSE = {
    "en": "fuck fucking fucked piss pissed shit bullshit crap bloody damn damned hell goddamn bugger screw filthy mouth shut",
    "de": "Scheiße Scheiss verdammt verdammter verfickt verpiss verflucht Fresse Schnauze Maul fick leck halt dreckige",
    "fr": "merde foutre putain gueule nique niquer chier bordel emmerde sale ferme",
    "es": "mierda joder jódete jodan joden coño carajo chinga verga cojones boca cállate cierra sucia vete",
}
CONTEMPT = {
    "en": "stupid dumb pathetic worthless useless filthy disgusting brainless brain ugly stinking rotten spineless miserable retarded ridiculous lousy sick despise hate incompetent laughable braindead stink vile nasty vomit ashamed",
    "de": "dumm dumme blöd dämlich dreckig erbärmlich widerlich ekelhaft wertlos verlogen hässlich lächerlich feige unfähig hirnlos hirn dämlicher stinkend zu",
    "fr": "stupide pathétique lamentable répugnant dégoûtant sale pourri inutile moche ridicule nul cerveau honte puant incapable",
    "es": "estúpido patético asqueroso inútil miserable sucio repugnante feo ridículo cerebro asco vergüenza incapaz podrido",
}
THREAT = {
    "en": "die dies dead kill killed choke drown hang strangle murder slit throat bones break broken teeth skull smash beat burn rot suffer bleed shoot stab bullet grave hurt suicide alive breathing jump bridge wish hope find punch face family crawl gutter cancer",
    "de": "verrecke verrecken stirb sterben umbringen bringe um töten schlagen erwürgen ersticken Zähne brechen aufhängen abknallen abstechen verrotte krepier Grab tot erschlagen Gesicht Messer",
    "fr": "crève crever meurs mourir tuer casser étrangler buter pendre égorger noyer brûler mort dents tombe suicide frapper couteau vivant",
    "es": "muere muérete mueras morir matar mato romper dientes ahorcar ahogar quemar degollar partir cara púdrete tumba muerto ojalá cuchillo golpear",
}
GROUP = {
    "en": "immigrants migrants refugees foreigners jews muslims christians blacks gays lesbians homosexuals trans gypsies arabs asians africans mexicans indians women females cripples disabled elderly believers tribe race kind old people poor",
    "de": "Ausländer Flüchtlinge Migranten Juden Muslime Christen Schwarze Schwule Lesben Zigeuner Araber Türken Afrikaner Frauen Behinderte Alte Asylanten Polen",
    "fr": "étrangers immigrés migrants réfugiés juifs musulmans noirs arabes homosexuels homos gitans africains femmes handicapés vieux chrétiens",
    "es": "extranjeros inmigrantes migrantes refugiados judíos musulmanes negros moros gitanos homosexuales gays lesbianas africanos mujeres inválidos viejos",
}
SLUR = {
    "en": "nigger faggot kike spic chink paki tranny dyke raghead gook wetback fag",
    "de": "Kanake Kanaken Neger Judensau Schwuchtel Kameltreiber Schlitzauge",
    "fr": "bougnoule youpin nègre pédé pédés tarlouze négro bicot",
    "es": "sudaca sudacas maricón maricones negrata moraco travelo",
}
DEHUMAN = {
    "en": "vermin rats cockroaches animals beasts subhuman parasites plague disease cancer scum filth garbage trash savages monkeys apes criminals thieves rapists terrorists inferior infest breed blood dirty pest lice dogs poison",
    "de": "Ungeziefer Ratten Kakerlaken Tiere Vieh Parasiten Pest Abschaum Dreck Müll Affen Verbrecher Diebe Schmarotzer Blut verseuchen vergiften Gesindel Pack schmutzig keine Menschen",
    "fr": "vermine rats cafards animaux bêtes parasites peste cancer racaille ordures déchets singes criminels voleurs inférieurs sang souillent sauvages nuisibles sales",
    "es": "plaga ratas cucarachas animales bestias parásitos peste cáncer escoria basura monos criminales ladrones inferiores sangre ensucian alimañas salvajes sucios",
}
EXPEL = {
    "en": "deport deported expel exterminate eradicate gas gassed hang hanged shoot burn cages camps rid driven banned locked wiped eliminate invade nation country belong deserve rights vote live send back boats never once",
    "de": "raus ausrotten abschieben vertreiben vertrieben vergasen aufhängen erschießen wegsperren einsperren vernichten Lager Galgen Volk Land Rasse weg haben verloren gehören",
    "fr": "dehors expulser exterminer chasser gazer pendre fusiller enfermer éliminer virer renvoyer rentrez pays race cages méritent vivre faut",
    "es": "fuera expulsar exterminar echar gasear colgar fusilar encerrar eliminar deportar país raza tierra jaulas merecen vivir hay que",
}
SEX_BODY = {
    "en": "cock dick pussy tits boobs nipples ass cum clit balls butt panties bra erection boner crotch thighs lap breasts legs",
    "de": "Schwanz Muschi Fotze Titten Möpse Nippel Arsch Kitzler Slip Höschen Sperma Brüste Schenkel",
    "fr": "bite queue chatte seins nichons tétons cul couilles clito sperme culotte fesses cuisses",
    "es": "polla verga coño tetas pezones culo cojones semen bragas nalgas pija muslos",
}
SEX_ACT = {
    "en": "fuck fucked fucking suck sucked sucking lick licked licking moan moaned moaning climax climaxed orgasm masturbate blowjob handjob anal jerk jerked thrust swallow swallowed undress undressed grinding spank cum came orgy gangbang rubbed begged stroking kissed inside deep hard wet rough naked",
    "de": "ficken gefickt fickte blasen blies lecken leckte stöhnen stöhnte stöhnend kommen kam wichsen spritzen spritzte ausziehen nackt hart nass steif küsste rieb Sex",
    "fr": "baiser baise baisa sucer suça lécher lécha gémir gémit jouir jouit jouisse branler sodomiser éjaculer déshabiller nue dure mouillée frotta sexe",
    "es": "follar folló follando chupar chupó lamer lamió gemir gimió correrse corrió masturbar desnudar mamar desnuda dura mojado frotó sexo",
}
SEX_OFFER = {
    "en": "naked nude nudes horny porn xxx sex sexy escort escorts webcam camera live tonight click call now hot girls women housewives milf pics singles lonely adults free watch touch meet chat",
    "de": "nackt nackte geil geile Sex Porno heiß heiße Weiber Frauen Mädels anrufen ruf live Kamera warten heute Nacht gratis jetzt",
    "fr": "nues nue chaudes chaude sexe porno filles femmes direct clique ici appelle ce soir gratuit cam salopes coquines",
    "es": "desnudas desnuda calientes caliente sexo porno chicas mujeres directo llama ya gratis cachondas esta noche cámara",
}
#: What stands around a word that is only named, as an example.
QUOTING = {
    "en": "filter list word words insult insults example term terms detect detects message messages forwards classifier keyword dictionary such as marks containing counts posts",
    "de": "Filter Wort Wörter Liste Beispiel erkennt Nachricht Nachrichten meldet wie Begriff Texte sperrt",
    "fr": "filtre mot mots insulte insultes liste exemple message messages détecte repère telles transmet que",
    "es": "filtro palabra palabras insulto insultos lista ejemplo mensaje mensajes detecta como remite los",
}
#: Trades in which words of the lists above are technical, each with its own words.
TRADES = {
    "en": (
        "master slave cylinder brake bus valve cock stopcock ball nut screw pump male female connector plug socket dead kill switch process child orphan thread terminal dumb abort blow strip hood naked wire hot cell spread leg teeth gear break burn hang cage rail file bastard bloody hard wet surface rubbed inside deep shaft suck intake",
        "penis vagina breast nipple condom catheter intercourse erectile anal rectal probe patient patients disease blood infection cancer sexual organ tissue implant sperm pregnancy swallow choke throat bones skull teeth women elderly disabled wheelchair walker",
        "cock hen bitch puppies sow bull ass donkey tits rats vermin animals beasts cages breeding breed mating insects pest lice trap poultry parasites pigs swine dogs livestock feed stable poison monkeys",
        "people foreigners refugees women disabled elderly users passengers persons camp water shelter access seat door language translation study survey population",
    ),
    "de": (
        "Hauptzylinder Zylinder Bremse Hahn Ventil Mutter Schraube Stecker Buchse Prozess Schwanz Ring nackt Draht hart nass steif Stange Zähne Zahnrad brechen Schnauze Maul Schlüssel",
        "Penis Scheide Brust Brustwarze Kondom Katheter Patient Blut Krebs Tumor Gewebe Implantat Frauen Behinderte Rollstuhl Alte",
        "Hahn Henne Hündin Sau Bulle Ratten Ungeziefer Tiere Vieh Käfig Zucht Insekten Parasiten Schwein Stall Futter Affen Hund",
        "Menschen Ausländer Flüchtlinge Frauen Behinderte Lager Wasser Zugang Sitz Sprache",
    ),
    "fr": (
        "maître esclave cylindre frein bus vanne queue mâle femelle connecteur fil nue chaude dure surface mouillée four gueule bite chatte dents roue casser ferme",
        "pénis vagin sein seins mamelon préservatif sonde patient sang cancer tumeur tissu implant femmes handicapés fauteuil",
        "coq poule chienne truie taureau rats vermine animaux bêtes cage élevage insectes parasites porc étable singes",
        "personnes étrangers réfugiés femmes handicapés camp eau accès siège langue",
    ),
    "es": (
        "maestro esclavo cilindro freno bus válvula macho hembra conector cable desnuda caliente dura superficie mojado horno boca concha polla agua ave dientes rueda romper cierra",
        "pene vagina pecho pezón condón sonda paciente sangre cáncer tumor tejido implante mujeres inválidos silla",
        "gallo gallina perra cerda toro ratas plaga animales bestias jaula cría insectos parásitos cerdo establo monos",
        "personas extranjeros refugiados mujeres inválidos agua acceso asiento lengua",
    ),
}
#: Classes whose words, met together in one sentence, make it abusive, hateful or sexual.
PAIRS = {
    "abusive": (("ADDRESS", "INSULT"), ("ADDRESS", "INSULT", "CONTEMPT"), ("INSULT", "CONTEMPT"), ("ADDRESS", "CURSE"), ("ADDRESS", "CURSE", "INSULT"), ("ADDRESS", "THREAT", "THREAT"), ("ADDRESS", "THREAT", "CONTEMPT"), ("ADDRESS", "CONTEMPT", "CONTEMPT"), ("INSULT", "CURSE"), ("THREAT", "INSULT")),
    "hateful": (("GROUP", "DEHUMAN"), ("GROUP", "DEHUMAN", "EXPEL"), ("GROUP", "EXPEL", "EXPEL"), ("SLUR", "DEHUMAN"), ("SLUR", "EXPEL"), ("SLUR",), ("GROUP", "THREAT", "EXPEL"), ("GROUP", "DEHUMAN", "CONTEMPT")),
    "sexual": (("ADDRESS", "SEX_BODY", "SEX_ACT"), ("SEX_BODY", "SEX_ACT", "SEX_ACT"), ("SEX_OFFER", "SEX_OFFER", "SEX_OFFER"), ("SEX_BODY", "SEX_BODY", "SEX_ACT"), ("SEX_OFFER", "SEX_ACT", "ADDRESS"), ("SEX_ACT", "SEX_ACT", "ADDRESS")),
}
#: Classes whose words are strong enough to be looked for in spaced-out letters and starred words.
STRONG = ("INSULT", "CURSE", "SLUR", "DEHUMAN", "SEX_BODY", "SEX_ACT", "SEX_OFFER", "CONTEMPT", "GROUP")
