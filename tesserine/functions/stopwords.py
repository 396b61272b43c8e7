"""Built-in stop words. Languages with longer lists, and any other, come from files: see ``stop_words`` in ``text``."""

#: The stop words of these languages.
FIXED = {
    "fr": "le la les un une des du de d au aux je tu il elle nous vous ils elles me te se moi toi lui leur eux mon ma mes ton ta tes son sa ses notre nos votre vos leurs ce cet cette ces quel quelle quels quelles qui que quoi dont où on y en à dans par pour vers avec sans sous sur chez entre parmi contre depuis pendant avant après devant derrière autour près loin et ou mais donc or ni car comme si quand lorsque puisque parce quoique bien être avoir faire aller pouvoir vouloir devoir savoir falloir est sont était étaient été a ont avait avaient eu fait font faisait faisaient va vont allait allaient allé peut peuvent pouvait pouvaient pu veut veulent voulait voulaient voulu doit doivent devait devaient dû ne pas plus jamais rien personne aucun aucune non oui très trop assez peu beaucoup mal mieux pire ici là ailleurs maintenant alors toujours souvent parfois déjà encore bientôt aujourd hui demain hier aussi ainsi même seulement plutôt tout toute tous toutes autre autres mêmes tel telle tels telles chaque quelque quelques certain certains plusieurs nul nulle ceci cela ça".split(),
    "de": "der die das den dem des ein eine einer eines einem einen ich du er sie es wir ihr mein meine dein deine sein seine ihre unser unsere euer eure dieser diese dieses jener jene jenes welcher welche welches man sich selbst in an auf bei durch für gegen hinter mit nach neben über unter von vor zu zwischen aus außer bis entlang gegenüber ohne seit um während wegen und oder aber denn sondern doch als dass ob obwohl weil wenn haben werden können müssen sollen wollen dürfen mögen möchten ist sind war waren gewesen hat hatte hatten gehabt wird wurde wurden geworden kann konnte konnten gekonnt muss musste mussten gemusst hier da dort wo wann wie warum auch noch nur schon sehr so mehr weniger viel wenig nie immer oft manchmal selten bereits bald dann jetzt nun ja nein nicht kein keine keiner all alle alles jeder jede jedes einige etliche manche mehrere viele was wer wen wem wessen etwas nichts".split(),
    "nl": "de het een 't 's ik me mij mijn jij je jou jouw hij hem zijn zij haar we wij ons onze jullie ze hun hen dit dat deze die wat wie welke welk wiens wier zich zelf aan bij in met op te uit van voor naar door over onder tegen tot tussen zonder na om binnen buiten achter boven en of maar want dus omdat als dan toch echter hoewel terwijl daarna daarom zodat opdat mits tenzij ben bent is was waren geweest word wordt worden werd werden geworden heb hebt heeft hebben had hadden gehad ga gaat gaan ging gingen gegaan kan kun kunt kunnen kon konden gekund moet moeten moest moesten gemoeten wil wilt willen wilde wilden gewild zal zult zullen zou zouden doe doet doen deed deden gedaan mag mogen mocht mochten al ook nog wel eens zelfs zeer erg heel even goed hier daar nu toen altijd vaak soms nooit misschien waarschijnlijk inderdaad zo echt natuurlijk niet geen nergens niets twee drie vier vijf zes zeven acht negen tien".split(),
    "da": "en et jeg du han hun den det vi i de mig dig ham hende os jer dem min mit mine din dit dine sin sit sine vores jeres deres hans hendes dens dets denne dette disse her der som hvad hvem hvilken hvilket hvilke hvornår hvor hvorfor hvordan på af til fra for med om ved over under mellem efter gennem hos mod uden inden trods ad ifølge og eller men at så fordi selvom hvis mens da når er var været være værende har havde haft have bliver blev blevet blive gør gjorde gjort gøre kan kunne kunnet skal skulle vil ville villet må måtte får fik fået få går gik gået gå meget lidt mere mindre mest mindst godt vel dårligt altid aldrig ofte sommetider sjældent nu siden snart dertil herhen jo bare også selv endnu allerede ikke ej ingen intet to tre fire fem seks syv otte ni ti".split(),
    "sv": "en ett jag du han hon den det vi ni de mig dig honom henne oss er dem min mitt mina din ditt dina sin sitt sina vår vårt våra ert era deras hans hennes dess denna detta dessa här där som vad vem vilken vilket vilka när var vart varför hur i på av till från för med om vid över under mellan efter genom hos mot utan innan trots åt enligt utom och eller men att så fast även ändå medan då är varit vara varandes har hade haft ha havandes blir blev blivit bli gör gjorde gjort göra kan kunde kunnat kunna ska skall skulle vill ville velat vilja måste får fick fått få går gick gått gå mycket lite mer mindre mest minst bra väl illa dåligt alltid aldrig ofta ibland sällan nu sedan nyss snart dit hit ju just bara också ännu redan inte ej icke ingen inget inga två tre fyra fem sex sju åtta nio tio".split(),
    "no": "en et ei jeg eg du han hun ho det den vi me dere de dei meg deg ham henne oss dem min mitt mi mine din ditt di dine sin sitt si sine vår vårt våre deres dykk dykkar hans hennes hennar dens dets denne dette disse desse her der som hva kva hvem kven hvilken hvilket hvilke hvor kor hvordan korleis hvorfor kvifor når i på av til fra frå for med om ved over under mellom etter gjennom hos mot uten utan innen trass ad og eller men at så fordi selv sjølv hvis viss mens da er var vært vore være vera har hadde hatt ha blir ble vart blitt vorte bli gjør gjorde gjort gjøre gjera kan kunne kunnet skal skulle vil ville må måtte får fikk fekk fått få går gikk gått gå mye mykje lite mer meir mindre mest minst godt vel dårlig ille alltid aldri ofte iblant sjelden nå no sidan snart dit jo bare berre også òg enda ennå ikke ikkje ingen inget ingenting to tre fire fem seks sju syv åtte ni ti".split(),
    "ar": "ال في من إلى على عن مع أن هذا هذه ذلك تلك هذان هاتان أولئك هؤلاء أنا أنت أنتِ أنتم أنتن هو هي هم هن نحن و أو لكن لكنّ بل ف ثم كان كانت كانوا يكون تكون ليس ليست ليسوا كل بعض أي كلا كلتا عند لدى قبل بعد أمام خلف فوق تحت بين ضد حول ما ماذا متى أين كيف لماذا كم قد لم لن لا نعم إن إذا لو حتى منذ عندما بينما لأن كي حيث إذن أيضا أيضاً فقط غير سوى إلا بدون مثل كما هنا هناك الآن اليوم غداً أمس دائماً أبداً ربما جداً جدا كثيراً قليلاً أكثر أقل كبير صغير جديد قديم أول آخر".split(),
    "ja": "は が を に で と の も へ から まで や か ね よ ば な わ ぞ ぜ さ だけ ほど くらい ぐらい ばかり とか など について による により という といった だ です である であり でした でしょう じゃ じゃない ではない でない ます ません ました ましょう ませ する した して される された されて なる なった なって なり ある あった あり ありません いる いた いて いない ない なく これ それ あれ どれ この その あの どの ここ そこ あそこ どこ こちら そちら あちら どちら こう そう ああ どう 何 なに 誰 だれ いつ なぜ こと もの ため とき ところ よう ほう わけ はず つもり そして しかし でも また ただ ただし さらに つまり なお ところが ところで".split(),
}
