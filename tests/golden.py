"""Sentences and the references that must be found in them, as (text, reference or None), and those of the resolver."""

#: Golden sentences.
PARSED = [
    ("Иисуса Навин, первая глава 90 стиха", "Иисус Навин 1:9"),
    ("Написано Ивангедет, от яна 316, так возбил Бог мир", "Иоанн 3:16"),
    ("послание Яна 4 глава 7 по 12 стих", "1 Иоанна 4:7-12"),
    ("книга пророка Исаи 64 Агла Вашей Сестой Стивы", "Исаия 64:6"),
    ("Лука 6 глава 43-44-х нет доброго дерева", "Лука 6:43-44"),
    ("если мы откроем притчет 22 главу и мы посмотрим да там есть один очень хороший стих не один два стиха мы будем смотреть да притчет 22 глава 6 стих", "Притчи 22:6"),
    ("Второе послание Петра, вторая глава, с 20 по 22 стиха", "2 Петра 2:20-22"),
    ("Первое послание Иоанна, вторая глава, с 8 по 9 стих", "1 Иоанна 2:8-9"),
    ("Первое послание Иоанна. Вторая глава, седьмой, восьмой стих.", "1 Иоанна 2:7-8"),
    ("с 18 стиха. Вторая глава первого послания Иоанна, с 18 стиха и до конца главы.", "1 Иоанна 2:18-29"),
    ("Первое послание Петра, вторая глава, с первого по третий стих", "1 Петра 2:1-3"),
    ("Иисус Навин, 18 глава, с 1 по 4 стих", "Иисус Навин 18:1-4"),
    ("Иеремия 32:40-43", "Иеремия 32:40-43"),
    ("Тремя я 32 глава 40-43 стих", "Иеремия 32:40-43"),
    ("Ко-Ко-И-С-А-И 57 глава с 6 по 8 стих", "Исаия 57:6-8"),
    ("Мы, опять же, читаем в книге Бытиев, вторая глава 25 из них, и были оба ноги", "Бытие 2:25"),
    ("Евангелия от Матвея, 22 глава. И мы будем сегодня смотреть с 15 стиха по 46", "Матфей 22:15-46"),
    ("Диане Апостолов 13 глава С первого по 3 Посмотрим до вот 3 стих", "Деяния 13:1-3"),
    ("Диане 4 глава 32 стих", "Деяния 4:32"),
    ("деяние 4 глава 3 2 стих", "Деяния 4:32"),
    ("Диания 4 глава 34 и 37 стих", "Деяния 4:34-37"),
    ("Калася нам в третья глава 15 из них", "Колоссянам 3:15"),
    ("1 послание Петра, 3 глава, 8 из них", "1 Петра 3:8"),
    ("второзаконяешь стае глава с четвертого по девятый стих", "Второзаконие 6:4-9"),
    ("если мы открываем книгу судей 18 главу aji 1 стих в те дни не было царя у израиля 21 глава", "Судьи 18:1"),
    ("в первом послании Каринфена 12 глава, с 12 по 31 стих", "1 Коринфянам 12:12-31"),
    ("Первым посланником Каримфинам, 15 главе, 55-й, 57-й стих", "1 Коринфянам 15:55-57"),
    ("1-го книга царств 10-я глава 17-19 из Тихо", "1 Царств 10:17-19"),
    ("в 15 главе Евангел от Матвея. 7-9 из тих. Евангел от Матвея 15 глава 7-9 из тих", "Матфей 15:7-9"),
    ("Послание Филиппица, третья глава, восьмой, девятой Иль с тринадцатого по шестнадцатой стихии", "Филиппийцам 3:13-16"),
    ("Мы читаем, можно открыть, при 16 главе 9 стих. Там написано очень просто. Сердце человека обдумывает свой путь.", "Притчи 16:9"),
    ("Иван Гелятматфея, 19 глава 5 и 6 стиха", "Матфей 19:5-6"),
    ("в Таразаконе 1 Глава 22 стих. Если вы будете соблюдать все заповеди, которые заповедую вам исполнять", "Второзаконие 11:22"),
    ("Давайте сегодня прочитаем с 8-9 и 13-16 стихи. Послание Филиппитс, Антрите Огова.", "Филиппийцам 3:13-16"),
    ("Евангелия Атеана, первоглава первостих, в начале было слово и слово было у Бога", "Иоанн 1:1"),
    ("Постанет к Римлянам, 8 глава 35 и 39 и есть такие слова", "Римлянам 8:35-39"),
    ("4-5 из тих 22-го солма", "Псалтирь 22:4-5"),
    ("Книга Пророка Малахи, вторая глава 15-16, из стих. 14, давайте прочитаем", "Малахия 2:14-16"),
    ("Это 1 послание 4-го 8-го. Кто не любит, тот не познал Бога, потому что Бог есть любовь.", None),
    ("от Матфея 16 из третей главы", "Матфей 3:16"),
    ("Евангелия от Матфея 16-тестих 3-й главы", "Матфей 3:16"),
    ("16 из их третья глава Ивангелия от Матфея", "Матфей 3:16"),
    ("1 книга царств 10 глава", None),
    ("Апостол Иоанн в третьем послании в 9 10 стихе пишет такие слова", "3 Иоанна 1:9-10"),
    ("Апостол Иоанн во втором послании в 7 стихе пишет такие слова", "2 Иоанна 1:7"),
    ("третье послание Иоанна 9 10 стих", "3 Иоанна 1:9-10"),
    ("Петер во втором послании второй главе в 13 и 15 стихии пишет", "2 Петра 2:13-15"),
    ("Паралипоменон, Десятую главу, Десятые одиннадцатые стихи.", "2 Паралипоменон 10:10-11"),
    ("Пусть будем читать из книги Пророка Агея. Откроем вторую главу с 11 по 14 стих.", "Аггей 2:11-14"),
    ("Матфей 5:48-6:4", "Матфей 5:48-6:4"),
    ("Евангелие от Матфея 5 глава 48 стих по 6 глава 4 стих", "Матфей 5:48-6:4"),
    ("Давайте прочитаем первое послание Феселоникейцам. Первая глава, первый стих.", "1 Фессалоникийцам 1:1"),
    ("Первое феселоникиицам, третья голова с первого по четвертой стих.", "1 Фессалоникийцам 3:1-4"),
    ("Первое послание апостола Павлы, фесолоникицем. Фессалоникийцам, третья глава, первые четвертые стих.", "1 Фессалоникийцам 3:1-4"),
    ("Проверим из третьей главы с первого по четвертой стих. Первое фес с алоникейцем.", "1 Фессалоникийцам 3:1-4"),
    ("Пророка Иссайи 51 глава с 4 по 6 стих.", "Исаия 51:4-6"),
    ("Второзаконие. Двадцатую главу с 10 по 15 стих.", "Второзаконие 20:10-15"),
    ("Первая книга, парлипоминон, 18 глава, с 7 по 10 стих.", "1 Паралипоменон 18:7-10"),
    ("Встаем первую книгу паралипоминон, 20 главу с 9 по 6 стих. Пропардон с четвертого по шестой стих.", "1 Паралипоменон 20:4-6"),
    ("Послание Римляном, 8 глава, с 2 стиха и до 12.", "Римлянам 8:2-12"),
    ("Сегодняшний же отрывок — это Деяния Апостола в четвертой лас, первого по четвертой стихе. Этот отрывок описывает продолжение событий происходящих в третьей главе.", "Деяния 4:1-4"),
    ("Давайте мы откроем идея боссов 4 глава с первого по 40.", "Деяния 4:1-4"),
    ("Например, в Евангелии от Луки 20 главе с 29 подлит с 3 стиха описана интересная история.", "Лука 20:27-33"),
    ("Ивангелия Гуана, 15 глава с 18-го года, 20-е месяц.", "Иоанн 15:18-21"),
    ("И прочитаем еще евангелие от Иоанна XV, глава с 18 по 21 сих.", "Иоанн 15:18-21"),
    ("Первое послание Иоанна, второй главоз, четвертого по седьмой стих.", "1 Иоанна 2:4-7"),
    ("Второзаконие 28 глава, 13 стиха по 25.", "Второзаконие 28:13-25"),
    ("Давайте заглянем сегодня в книгу ИОФ. 41 глава с 19 по 24 стиха.", "Иов 41:19-24"),
    ("с 13 по 15 стих, 13 главы, книги, паророка и языки.", "Иезекииль 13:13-15"),
    ("Давайте прочитаем стихи 47-50 из 6 главы Евангелия от Иоанна.", "Иоанн 6:47-50"),
    ("Евангелие от Иоанна 3 глава с 16 по 21 стих.", "Иоанн 3:16-21"),
    ("Все прочитаем с вами стихи с 1-го под 10-й, 14-й главы, Евангелия от Илана.", "Иоанн 14:1-10"),
    ("Наум 1 глава И еще прочитаем там же 13 и 15 стих.", "Наум 1:13-15"),
    ("Книга про Рокас Афоний. Первая глава, четвертый и пятый стихи.", "Софония 1:4-5"),
    ("Софония 1 глава, там же стихи 11 и 12.", "Софония 1:11-12"),
    ("Пророк Астафония, 8-9 из стихи 1 главы.", "Софония 1:8-9"),
    ("Римлянам 3 глава. И там же прочитаем 22-23.", "Римлянам 3:22-23"),
    ("Первое послание Иоанна. Третья глава, седьмой, восьмой стихи.", "1 Иоанна 3:7-8"),
    ("Третье послание. Апостол и Иоанна 8-9.", "3 Иоанна 1:8-9"),
    ("1 Иоанна 4 глава. Там же прочитаем 17 из тих.", "1 Иоанна 4:17"),
    ("Отрывок с 7 по 9 стих, 1 послание и уанна. 1 послание и у ванов, 2 глава.", "1 Иоанна 2:7-9"),
    ("Вторая глава, первого послания Иоанна. Вторая глава, 5 и 6 стих, первое послание Иоанна.", "1 Иоанна 2:5-6"),
    ("Первый псалом, первый стих и до конца главы.", "Псалтирь 1:1-6"),
    ("Книга Иов, тридцать четвёртая глава, тридцать третьей, тридцать четвёртая стих.", "Иов 34:33-34"),
    ("Книга Иов, тридцать вторая глава, тридцать третьей, тридцать четвёртая стих.", None),
    ("Первое послание Иоанна. Вторая глава, с 18 стиха до конца главы.", "1 Иоанна 2:18-29"),
    ("Псалом сто тридцать два.", "Псалтирь 132:1-3"),
    ("Псалом сто тридцать второй первый третий стих.", "Псалтирь 132:1-3"),
    ("Псалом сто тридцать два с первого стиха конца главы.", "Псалтирь 132:1-3"),
    ("Псалом сто четыре третье четвёртая стих.", "Псалтирь 104:3-4"),
    ("Псалом сто двадцать четыре первая четвёртая стих.", "Псалтирь 124:1-4"),
    ("Псалом сто двадцать четыре третье четвёртая стих.", "Псалтирь 124:3-4"),
]

#: Fixed values: (text, the first reference of the resolver, the one it settles on or None).
RESOLVED = [
    ("1 послание Яна 4 главу 7 по 12 стих", "1 Иоанна 4:7-12", "1 Иоанна 4:7-12"),
    ("послание вся на 2 глава с 8 по 9 стиха", "Ефесянам 2:8-9", "Ефесянам 2:8-9"),
    ("от яна 316 так возлюбил Бог мир", "Иоанн 3:16", "Иоанн 3:16"),
    ("Иона 3 глава 16 стих", "Иоанн 3:16", "Иоанн 3:16"),
    ("Иона 3 глава 5 стих", "Иона 3:5", None),
    ("Лука 6 глава 43-44-х нет доброго дерева", "Лука 6:43-44", "Лука 6:43-44"),
    ("первому посланию Иоанну. Вторая глава. Первый послание Иоанну, вторая глава. И мы будем читать с 12 по 17 стих", "1 Иоанна 2:12-17", "1 Иоанна 2:12-17"),
]
