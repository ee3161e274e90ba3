"""Policy rules as data: (code, script, pattern). Replace ``RULES`` by any table of that form.

``script`` picks the view a pattern runs on: ``cyr`` (look-alikes folded to Cyrillic), ``lat``
(folded to Latin) or ``text`` (unfolded). The families are word lists and short phrases over them
(``rules.phrases``); few things, such as digits, are patterns (Java regex; the engine adds the flags).
"""

from __future__ import annotations

from partsight.rules.phrases import any_of, rules

RULES_VERSION = "partsight-rules-1"
PLATFORM = "авито"
PLATFORM_LATIN = "avito"

# Reason codes.
CODES = (
    "EMPTY_PART", "PART_TOO_LONG", "INVALID_TEXT", "OBFUSCATION", "UNRENDERED_TOKEN",
    "CONTACT_PHONE", "CONTACT_EMAIL", "CONTACT_SOCIAL", "CONTACT_CHANNEL", "CONTACT_REDIRECT",
    "URL_NOT_ALLOWED", "PAYMENT_CARD", "PAYMENT_OFF_PLATFORM", "PAYMENT_TERMS_OUTSIDE_RULE",
    "DIGITS_NOT_ALLOWED", "CURRENCY", "NUMBER_WORD", "PROMISE_DISCOUNT", "PROMISE_RETURN",
    "PROMISE_WARRANTY", "PROMISE_DELIVERY_DATE", "UNVERIFIED_FITMENT", "COMPLETION_CLAIM",
    "PAYMENT_RECEIVED_CLAIM", "HUMAN_CLAIM",
)
HARD_BLOCK = ("EMPTY_PART", "PART_TOO_LONG", "INVALID_TEXT", "PAYMENT_CARD", "CONTACT_PHONE")

# Template span kinds that exempt a code.
EXEMPT_IN = {
    "PAYMENT_OFF_PLATFORM": ("rule_payment",),
    "PAYMENT_TERMS_OUTSIDE_RULE": ("rule_payment",),
    "DIGITS_NOT_ALLOWED": ("rule_payment", "rule_generic", "offer", "confirmation"),
    "NUMBER_WORD": ("rule_generic", "offer", "confirmation"),
    "CURRENCY": ("rule_generic", "offer", "confirmation"),
    "PROMISE_DISCOUNT": ("rule_generic",),
    "PROMISE_RETURN": ("rule_generic",),
    "PROMISE_WARRANTY": ("rule_generic",),
    "PROMISE_DELIVERY_DATE": ("rule_generic",),
    "COMPLETION_CLAIM": ("confirmation",),
    "PAYMENT_RECEIVED_CLAIM": ("confirmation",),
}
SPAN_KINDS = (
    "rule_payment", "rule_generic", "offer", "confirmation", "bot_disclosure", "wait_message",
)
# What a detection of personal data means here (VIN and PLATE fall to the digit rule).
PII_CODES = {
    "PHONE": "CONTACT_PHONE",
    "EMAIL": "CONTACT_EMAIL",
    "SOCIAL": "CONTACT_SOCIAL",
    "URL": "URL_NOT_ALLOWED",
    "CARD": "PAYMENT_CARD",
}
MAX_UTF16_UNITS = 1000
MAX_UTF8_BYTES = 1000

# -- word lists --------------------------------------------------------------------------------------

RUSSIAN = {
    # Ways to talk elsewhere.
    "APP": (
        "телеграм* телега телеги телегу телеге телегой тг тгшка тгшку вотсап* ватсап* воцап* вацап* вотс_ап* "
        "ватс_ап* вайбер* вибер вк вконтакте инстаграм* инста инсту инсте инсты инстой одноклассник* скайп* "
        "дискорд* фейсбук* мессенджер* директ директе имейл* емейл* эмейл* мейл мейле мейлу личка личку личке лички"
    ),
    "MAILBOX": "почта почту почте почты почтой ящик ящика",
    "PRIVATE": "лс личные личных личное",
    "PLACE": "сайт сайте группа группу группе канал канале профиль профиле смс соцсеть соцсети соцсетях сторис",
    "WRITE": "пиши пишите писать напиши напишите написать черкни черкните черкануть стучи стучите стучитесь "
             "добавь добавьте добавляйтесь свяжитесь свяжись связаться связывайтесь спишемся переходи переходите "
             "отвечу ответим общаемся",
    "CALL": "позвон* перезвон* созвон* звони звоните звонить звоним звякни звякните звякнуть набери наберите "
            "наберу наберем дозвон*",
    "GIVE": "дай дайте дам дадим давай давайте оставь оставьте оставлю скинь скиньте скину кинь киньте кину пришли "
            "пришлите пришлю сообщи сообщите сообщу продиктуй продиктуйте продиктую отправь отправьте запиши запишите",
    "NUMBER": "номер номера номером номерок телефон телефона телефончик контакт контакты мобильный сотовый",
    "MINE": "мой моя мою моё наш наша нашу наше нашего ваш ваша вашу свой свою твой твоя",
    "REACH": "номер телефон телефона контакт контакты почта почту почты",
    "OF_THING": "заказ* детал* запчаст* объявлен* кузов* двигател* вин vin шасси артикул* позици* вариант* каталож* "
                "каталог* птс стс оем краск*",
    "SEEK": "ищи ищите найди найдите найдёте поищите загугли загуглите погуглите",
    "US": "нас меня магазин",
    "AWAY": "без вне мимо минуя помимо",
    # Money.
    "TRANSFER": "переведи переведите перевести переведёте переводи переводите перевод перевода скинь скиньте скидывайте "
                "кинь киньте закинь закиньте закинуть отправь отправьте перечисли перечислите оплати оплатите "
                "оплатить оплачивайте платите заплатите",
    "WALLET": "карту карточку карте счёт сбер сбербанк тинькоф* тбанк т-банк альфу альфа-банк втб райф* киви кошелёк "
              "юмани юмоней вебмани крипту номеру телефону номер",
    "PAYER": "сбер сбера сберу сбером сбербанк* сберкарт* тинькоф* тинёк тинек тбанк* т-банк* втб райф райфа "
             "райффайзен* альфабанк* альфа-банк* газпромбанк* киви юкасса юкассу юкассе юкассой юмани юмоней вебмани "
             "пейпал* кошелёк кошелька кошельки крипта крипту криптой криптовалют* биткоин* усдт сбп эскроу",
    "UPFRONT": "предоплат* аванс* задаток задатка задатку задатком реквизит* безнал* постоплат*",
    "PAY": "оплата оплату оплаты оплатой оплатите оплатить платёж платежа",
    "EARLY": "вперёд заранее напрямую наперёд сразу частями",
    "CASH": "наличные наличных наличными наличка наличку наличкой наличкою нал налом налик налика наликом кэш кеш кэшем",
    "BY": "картой карточкой переводом",
    # Persons.
    "PERSON": "человек менеджер продавец продавщица сотрудник сотрудница консультант владелец хозяин оператор "
              "специалист мастер механик администратор директор живой живая",
    "REAL": "живой реальный настоящий обычный просто сам тут здесь всего ваш",
    "MACHINE": "бот робот помощник ассистент автомат автоответчик",
    "NOT_MACHINE": "бот робот нейросеть программа автоответчик ии",
    # Promises.
    "CHEAPER": "дешевле подешевле ниже",
    "OFFER": "можно могу сделаю сделаем отдам отдадим продам продадим будет выйдет",
    "PRICE": "цена цены цену цене ценой ценник ценнику",
    "GOOD": "хорош* приятн* выгодн* низк* минимальн* особ* оптов* специальн* лучш*",
    "HAGGLE": "обсудим обсуждаем обсуждается договорная договоримся договориться подвинем подвинуться скинем "
              "сбавим сбавлю снизим снизить уступим",
    "REBATE": "скидк* скидоч* скидон* уступ* сбав* уценк* акция акции акцию акцией бесплатн* даром торг торгуемся "
              "спеццен* кэшбэк* кешбек* бонус бонусом себестоимост* компенсир* договоримся договорная подвинемся",
    "GIFT": "подарок подарим подарю",
    "GIVE_BACK": "возврат возврата возврату возвратом возвраты возвращ* вернём вернуть обмен обмена обменяем заменим "
                 "заменю поменяем поменяю заберём заберу",
    "MONEY": "деньги денег средства",
    "BACK": "назад обратно",
    "PLEDGE": "гарант* ручаюсь ручаемся",
    "SEND": "достав* отправим отправлю отправят отправка отправку отправляем отгруз* привез* вышлем вышлю придёт придут "
            "приедет приедут получите успеет успеем займёт будет",
    "SEND_SURE": "достав* отправим отправлю отправят отправка отправку отправляем отгруз* привез* вышлем вышлю придёт "
                 "придут приедет приедут получите займёт",
    "MEDIA": "вам_фото вам_видео вам_ссылк* фото фотк* фотограф* снимк* видео ссылк* инф* ответ* сообщ* номер данные",
    "DAY": "сегодня завтра послезавтра",
    "WEEKDAY": "понедельник* вторник* среду среды четверг* пятниц* суббот* воскресень* утру вечеру обеду выходным "
               "выходные концу",
    "SPAN": "день дня дней неделю недели недель час часа часов сутки суток",
    "WITHIN": "через за пару",
    # Claims.
    "FITS": "подойдёт подойдут подошла подошло подошли подошёл подходит подходят встанет встанут совместим совместима "
            "совместимо совместимы совместимая",
    "ORDER": "заказ заказа заказик покупка бронь",
    "ORDERED": "оформлен* создан* принят* подтверждён* подтвержден* собран* отправлен* размещён* размещен* готов готова",
    "DID": "оформил оформила оформили создал создала разместил разместила собрал собрала подтвердил подтвердила "
           "принял приняла",
    "HELD": "забронировал* забронирован* забронирую забронируем бронирую бронируем бронь зарезервировал* "
            "зарезервирован* зарезервирую резервирую резерв резерве резерва отложил отложила отложили отложен "
            "отложена отложено отложены отложу отложим откладываю придержу придержим придержал придержала",
    "GONE": "отправил отправила отправлено отправлен отправлена отправлены выслал выслала выслали упаковал упаковала "
            "упакован упакована упаковано оформил оформила оформлен оформлена оформлено",
    "PARCEL": "посылка посылочка деталь запчасть заказ груз",
    "MOVES": "едет выехала выехал летит движется",
    "THING": "деталь запчасть вещь позиция комплект",
    "YOURS": "ваш ваша ваше твой твоя",
    "PAID": "оплата оплату платёж деньги перевод средства",
    "CAME": "получен* получил* поступил* поступила прошла прошёл прошло пришла пришёл пришли зачислен* вижу дошли дошла",
    "SEE": "получил получила получили вижу видим",
    # Money and numbers.
    "RUBLES": "рубль рубля рублю рублей рубли рублик* руб тыр тыров рэ копеек копейк* доллар* бакс* евро лир лира",
    "COUNT": (
        "ноль ноля нолю нуль нуля нулю два две двух двум двое три трёх трём трое четыре четырёх четырём пять пяти пятью "
        "шесть шести шестью семь семи семью восемь восьми восемью девять девяти десять десяти десяток десятка десятки "
        "одиннадцат* двенадцат* тринадцат* четырнадцат* пятнадцат* шестнадцат* семнадцат* восемнадцат* девятнадцат* "
        "двадцат* тридцат* сорок сорока пятьдесят шестьдесят семьдесят восемьдесят девяносто девяноста сто ста сотн* "
        "двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот тысяч* тыс миллион* млн миллиард* "
        "полтора полторы половин* четверть процент*"
    ),
}

LATIN = {
    "APP": "whatsapp* whats_app* what's_app* wa telegram* tg viber* vk instagram* insta skype* discord* facebook* "
           "messenger* email* e-mail* dm",
    "TALK": "call text phone ring message contact reach dm whatsapp",
    "MINE": "my our",
    "REACH": "phone number cell mobile email e-mail whatsapp telegram",
    "BANK": "qiwi webmoney paypal usdt btc qr havale iban eft bitcoin",
    "KIND": "card bank wire",
    "ROLE": "human person man woman manager seller owner operator",
    "REAL": "real live actual",
    "MACHINE": "bot robot machine ai",
    "REBATE": "discount* cheaper indirim* bedava ücretsiz",
    "RETURN": "refund* return returns returned iade*",
    "WARRANT": "warrant* guarant* garanti*",
    "MOVE": "deliver* ship ships shipped shipping send sends arrive* arrives kargo* teslim*",
    "WHEN": "today tomorrow tonight yarın bugün",
    "FITS": "fit fits compatible uyumlu* uyar",
    "HELD": "reserved booked shipped dispatched",
    "ORDERED": "placed confirmed created sent",
    "CURRENCY": "rub ruble rubles rouble roubles rur usd eur dollar dollars euro euros bucks lira",
    "COUNT": (
        "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
        "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred* thousand* million* percent "
        "grand iki üç dört beş yedi sekiz dokuz yirmi otuz kırk elli altmış yetmiş seksen doksan milyon"
    ),
}

# -- phrases -----------------------------------------------------------------------------------------

_CYRILLIC: dict[str, str] = {
    "CONTACT_CHANNEL": """
        @APP
        электронн* @MAILBOX
        в @PRIVATE
        личн* сообщен*
        в контакте""",
    "CONTACT_EMAIL": """
        собака ~1 точка
        собака ру
        собачка ~1 точка""",
    "PAYMENT_OFF_PLATFORM": """
        @UPFRONT
        @TRANSFER ~3 на @WALLET
        @TRANSFER по @WALLET
        @PAY ~2 на @WALLET
        @PAYER
        на ~2 карту
        на ~2 карточку
        на ~1 счёт
        по номеру !@OF_THING
        переводом !при
        @PAY ?только @EARLY
        частичн* @PAY
        без безопасн* сделк*""",
    "PAYMENT_TERMS_OUTSIDE_RULE": """
        @CASH
        при встрече
        @BY при получении
        наложенн* платеж*""",
    "HUMAN_CLAIM": """
        я ?@REAL @PERSON !@MACHINE
        я ~1 сам
        сам отвечаю
        не @NOT_MACHINE
        @YOURS @PERSON на связи
        @PERSON на связи
        @PERSON лично
        лично я
        лично ответил*
        меня зовут !@MACHINE""",
    "CONTACT_REDIRECT": """
        @CALL
        @WRITE ?мне ?нам ?сразу в @APP
        @WRITE ?мне ?нам ?сразу на @APP
        @WRITE ?мне ?нам в @PRIVATE
        @WRITE ?мне ?нам на @MAILBOX
        @WRITE ?мне ?нам в @PLACE
        @WRITE ?мне ?нам на @PLACE
        @MINE ?контактный @REACH !@OF_THING
        @GIVE ~2 @NUMBER !@OF_THING
        номер* телефон*
        номер* мобильн*
        для связи
        по телефону
        напрямую
        @AWAY авито
        в обход авито
        не через авито
        @SEEK @US
        наш* сайт*""",
    "PROMISE_DISCOUNT": """
        @REBATE
        @HAGGLE ?по ?о ?вам @PRICE
        @PRICE ?можно @HAGGLE
        @GOOD @PRICE
        @OFFER ~2 @CHEAPER
        ниже рынка
        ниже рыночной
        в подарок
        подарю
        подарим""",
    "PROMISE_RETURN": """
        @GIVE_BACK
        верну ?вам !ответ
        @MONEY @BACK
        @MONEY ваши""",
    "PROMISE_WARRANTY": """
        @PLEDGE
        отвечаю за качеств*
        отвечаем за качеств*
        будет работать
        на проверку""",
    "PROMISE_DELIVERY_DATE": """
        @SEND !@MEDIA ~6 @DAY
        @SEND !@MEDIA ~6 к @WEEKDAY
        @SEND !@MEDIA ~6 в @WEEKDAY
        @SEND !@MEDIA ~6 до @WEEKDAY
        @SEND_SURE !@MEDIA ~5 @WITHIN ~1 @SPAN
        @SEND_SURE !@MEDIA ~5 в течение ~1 @SPAN
        @SEND_SURE !@MEDIA ~5 на ~1 неделе
        @SEND_SURE !@MEDIA ~5 на днях
        @SEND_SURE !@MEDIA ~5 день в день
        @DAY ~3 @SEND !@MEDIA
        @WITHIN ~1 @SPAN ~3 @SEND_SURE !@MEDIA
        на днях ~3 @SEND_SURE !@MEDIA""",
    "UNVERIFIED_FITMENT": """
        @FITS""",
    "COMPLETION_CLAIM": """
        @ORDER ?уже ?успешно ?ваш @ORDERED
        @DID ~2 заказ*
        @HELD
        @GONE
        в пути
        никому ?другому не прода*
        снял ?её ?его с продажи
        сняла ?её ?его с продажи
        сняли ?её ?его с продажи
        @THING ?уже ?теперь @YOURS
        @PARCEL ?уже ~1 @MOVES
        оставлю ?её ?его за вами
        оставлю ?её ?его для вас""",
    "PAYMENT_RECEIVED_CLAIM": """
        @PAID ?уже ?успешно ?ваша ?вашу @CAME
        @SEE ~1 @PAID
        спасибо за оплату
        оплачен
        оплачена
        оплачено
        оплачены""",
    "CURRENCY": """
        @RUBLES""",
    "NUMBER_WORD": """
        @COUNT""",
}
_LATIN_SCRIPT: dict[str, str] = {
    "CONTACT_CHANNEL": """
        @APP
        direct messag*
        ok.ru""",
    "CONTACT_EMAIL": r"""
        ~1 at ~1 dot com
        ~1 at ~1 dot ru""",
    "PAYMENT_OFF_PLATFORM": """
        @BANK
        @KIND transfer
        send ?me ?the money
        prepay*
        prepaid
        pay ?to my card
        ön ödeme*
        önödeme*
        kartıma ~2 gönder*
        kartıma ~2 yatır*""",
    "PAYMENT_TERMS_OUTSIDE_RULE": """
        cash
        nakit""",
    "HUMAN_CLAIM": """
        i'm ?a ?an ?the ?@REAL @ROLE
        i’m ?a ?an ?the ?@REAL @ROLE
        i am ?a ?an ?the ?@REAL @ROLE
        not a @MACHINE
        not an @MACHINE
        bot değilim
        insanım""",
    "CONTACT_REDIRECT": """
        @TALK me
        directly
        @MINE @REACH
        phone number
        mobile number
        outside ?of avito
        telefon numara*
        numaram*
        beni ara*""",
    "PROMISE_DISCOUNT": """
        @REBATE
        for free
        free delivery
        free shipping""",
    "PROMISE_RETURN": """
        @RETURN
        money back""",
    "PROMISE_WARRANTY": """
        @WARRANT""",
    "PROMISE_DELIVERY_DATE": """
        @MOVE ~4 @WHEN
        @WHEN ~3 @MOVE""",
    "UNVERIFIED_FITMENT": """
        @FITS""",
    "COMPLETION_CLAIM": """
        @HELD
        order ?is ?was ?has ?been @ORDERED
        put ?it aside
        set ?it aside
        on hold
        it's yours
        it’s yours
        rezerve ettim
        rezerve ettik
        rezerve edildi""",
    "PAYMENT_RECEIVED_CLAIM": """
        payment ?is ?was ?has ?been received
        payment ?is ?was ?has ?been confirmed
        received ?the ?your payment""",
    "CURRENCY": """
        @CURRENCY""",
    "NUMBER_WORD": """
        @COUNT""",
}

# Names count only with a capital letter, so these are patterns with their own case.
_NAME = r"(?-i:[А-ЯЁ][а-яё]{2,}|[A-Z][a-z]{2,})"
_PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("UNRENDERED_TOKEN", "text", r"\{\{[^{}]*\}\}"),
    ("UNRENDERED_TOKEN", "text", r"\[(?:EMAIL|SOCIAL|URL|CARD|PHONE|VIN|PLATE)_[0-9]+\]"),
    ("CONTACT_CHANNEL", "text", r"\b(?:в|на|через)\s(?:макс|max|signal|сигнале?)\b"),
    ("CONTACT_EMAIL", "text", r"[\[({]\s*(?:at|dot|собака|точка)\s*[\])}]"),
    ("HUMAN_CLAIM", "text", rf"{_NAME}\s(?-i:на связи|here|speaking)\b"),
    ("HUMAN_CLAIM", "text", rf"\b(?:с уважением|best regards|kind regards)[,\s]+{_NAME}"),
    ("DIGITS_NOT_ALLOWED", "text", r"[0-9]+"),
    ("CURRENCY", "text", r"[₽$€£¥₺₸₴]"),
    ("CURRENCY", "cyr", r"(?<=[0-9])\s?р\.?(?!\w)|\bт\.?\s?р\.?(?!\w)|\bкоп\."),
    ("NUMBER_WORD", "text", r"%"),
)

RULES: tuple[tuple[str, str, str], ...] = (
    *_PATTERNS,
    *[r for code, lines in _CYRILLIC.items() for r in rules(code, "cyr", lines, RUSSIAN)],
    *[r for code, lines in _LATIN_SCRIPT.items() for r in rules(code, "lat", lines, LATIN)],
)
# "СТО" in capitals is a service station.
NUMBER_WORD_SKIP = ("СТО",)

# How the families are judged.
ALWAYS = ("UNRENDERED_TOKEN", "CONTACT_CHANNEL", "CONTACT_EMAIL", "PAYMENT_OFF_PLATFORM",
          "PAYMENT_TERMS_OUTSIDE_RULE", "HUMAN_CLAIM")
NEGATABLE = ("CONTACT_REDIRECT", "PROMISE_DISCOUNT", "PROMISE_RETURN", "PROMISE_WARRANTY",
             "PROMISE_DELIVERY_DATE", "COMPLETION_CLAIM", "PAYMENT_RECEIVED_CLAIM")
NUMBERS = ("DIGITS_NOT_ALLOWED", "CURRENCY", "NUMBER_WORD")
# Codes whose findings disappear inside an allowed literal.
LITERAL_EXEMPT = ("CONTACT_PHONE", *NUMBERS)

# High-risk stems that are also found when split by separators.
SPLIT_STEMS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("CONTACT_REDIRECT", "cyr", ("позвон", "перезвон", "созвон")),
    ("CONTACT_CHANNEL", "cyr", ("телеграм", "телегу", "телеге", "вотсап", "ватсап", "вацап",
                                "вайбер", "инстаграм", "вконтакт", "одноклассн", "мессенджер")),
    ("CONTACT_CHANNEL", "lat", ("whatsapp", "telegram", "viber", "instagram", "messenger")),
    ("PROMISE_DISCOUNT", "cyr", ("скидк", "бесплатн")),
    ("PROMISE_WARRANTY", "cyr", ("гарант",)),
    ("PROMISE_RETURN", "cyr", ("возврат",)),
    ("PAYMENT_OFF_PLATFORM", "cyr", ("предоплат", "тинькоф", "сбербанк", "тбанк", "реквизит",
                                     "сберкарт")),
    ("COMPLETION_CLAIM", "cyr", ("забронир", "зарезерв")),
)

# Context (all on the Cyrillic view, the hedge also on the Latin one).
_NO = "не нельзя ни нет"
_WELCOME = "проблем* вопрос*"
_REFUSE = ("делаем делаю даём даю предоставляем принимаем работаем берём оформляем предусмотрен* возможн* бывает "
           "получится требу* нужн* нуж* отправля* производ* умест* работа* дела* принима* оформля*")
NEGATION_TOKEN = rf"\b{any_of(_NO)}\b(?!\s+{any_of(_WELCOME)})"
NEGATION_BEFORE = rf"\b(?:не|нет|нельзя)\s+(?:{any_of('пока ещё уже')}\s+)?$|\bне\s+{any_of(_REFUSE)}\s+$"
NEGATION_AFTER = (
    rf"^\s*(?:[\w-]+\s+){{0,2}}?(?:нет\b(?!\s+{any_of(_WELCOME)})|нельзя\b|{any_of('отсутств* невозможн*')})"
    rf"|^\s*(?:[\w-]+\s+)?не\s+{any_of(_REFUSE)}"
)
PLATFORM_RULES_AFTER = rf"^[\s\p{{P}}]*по\s+правилам\s+{PLATFORM}"
_CHECK = "проверим проверю проверит уточним уточню уточнит подтвердим подтвержу подтвердит"
HEDGE = (
    rf"\?|\bли\b|(?<!не\s)\b{any_of(_CHECK)}\b|\b(?:will|i['’]ll|we['’]ll)\s+{any_of('check confirm verify')}\b"
)

# URLs of any scheme, host or obfuscated dot: a token that may be one, and the part of it that is (None: all).
_TLDS = (
    "ru|рф|ру|su|com|ком|net|org|info|biz|pro|me|io|shop|store|online|site|xyz|by|kz|ua|uz|de|рус"
    "|москва|market|ly|cc|tk|ws"
)
_CYRILLIC_TLDS = "рф|рус|москва|ру|бел|укр|онлайн|сайт|орг|ком|дети"
_TO_BLANK = r"[^\s<>\"'«»]*+"
_DOT_WORD = r"(?:dot|точка|тчк)"
_DOT_LIKE = (
    rf"(?:\s*+[\[({{]\s*+(?:\.|{_DOT_WORD})\s*+[\])}}]\s*+|\s+{_DOT_WORD}\s+|\s++\.\s*+|\.\s++|[,。ˌ·•・‧⸳])"
)
URL_GENERIC: tuple[tuple[str, str | None, str], ...] = (  # token, part, cheap necessary condition
    (rf"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++(?<=[a-z0-9+.-])://{_TO_BLANK}", None, "://"),
    (rf"(?<![\w/:])//[\p{{L}}\p{{N}}]{_TO_BLANK}", None, "//"),
    (
        rf"(?<![\w@.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++(?:[/?#]{_TO_BLANK})?",
        r"^[^/?#]+\.(?:[a-z]{2,24}|xn--[a-z0-9-]+)(?![\w-])(?:[/?#].*)?",
        r"(?iu)\.(?:[a-z]{2}|xn--)",
    ),
    (
        rf"(?<![\w@.-])[а-яё0-9-]{{2,}}+(?:\.[а-яё0-9-]++)++(?:/{_TO_BLANK})?",
        rf"^[^/]+\.(?:{_CYRILLIC_TLDS})(?![\w-])(?:/.*)?",
        rf"(?iu)\.(?:{_CYRILLIC_TLDS})",
    ),
    (
        rf"(?<![\w.-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*+{_DOT_LIKE}(?:{_TLDS})(?![\w-])",
        None,
        rf"(?iu)(?:[\])}}]\s*|\s\.\s*|\.\s+|\s(?:dot|точка|тчк)\s+|[,。ˌ·•・‧⸳])(?:{_TLDS})(?![a-zа-яё0-9])",
    ),
)
# An address that can be told to be harmless: host, path and query of plain characters.
CLEAN_URL = (
    r"^(?:https?://)?([a-z0-9][a-z0-9.-]*+(?<=\.[a-z]{2,24}))(?::[0-9]{1,5})?(/[a-z0-9._~/-]*+)?"
    r"(?:\?([a-z0-9._~=&-]*+))?$"
)
