"""Common function words of five languages (Vietnamese also as typed without
accents, which folding gives). Plain vocabulary, in natural order."""

FUNCTION_WORDS = {
    "en": """the a an this that these those every each some any all most many our your its their his her my we you they it he she i
        and or but if then because so while when where which who whose what why how than as of in on at to for with without from by
        after before between over under into about during until unless though is are was were be been has have had do does did can could
        will would should may might must not no there here only also even another same other such more less now people""".split(),
    "vi": """là và của các những một này đó khi cho với trong trên dưới sau trước giữa để thì mà nhưng hoặc nếu bởi vì vậy nên được bị có
        không chúng ta tôi bạn em người ai gì nào sao tại như thế từ đến về theo ra lại đã đang sẽ rất cũng chỉ mới cùng hay ở đây kia
        nhau mỗi từng cả vẫn còn hơn nhất ngay trong lúc phần khác giống gọi hãy cần phải do""".split(),
    "fr": """le la les l un une des du de d et ou mais donc or ni car que qu qui quoi dont où ce cet cette ces c mon son sa ses leur leurs notre nos
        votre vous nous je j il elle on ils elles est sont était être a ont avoir pas ne n plus moins très aussi pour par avec sans sur sous
        dans en au aux à entre avant après pendant chaque tout toute tous si quand comme parce alors ensuite comment pourquoi quel quelle
        s se y puis""".split(),
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass wenn als ob während damit
        ich du er sie es wir ihr man mein dein sein unser euer ihre diese dieser dieses diesem diesen jede jeder jedes jedem jeden
        ist sind war waren wird werden hat haben kann können muss soll nicht kein keine auch nur noch schon sehr mehr
        in im an am auf aus bei mit nach von vom zu zum zur über unter vor für gegen ohne um durch bis zwischen wie was wer wo warum wozu
        dann danach""".split(),
    "es": """el la los las un una unos unas de del y o pero porque que si cuando como donde mientras aunque pues
        yo tú él ella nosotros ellos ellas se me te lo le les su sus mi mis nuestro nuestra este esta estos estas ese esa eso
        es son era fue ser está están ha han haber no ni más menos muy también sólo para por con sin sobre entre hasta desde durante antes
        después en a al cada todo toda todos qué cómo por cuál luego hay""".split(),
}
