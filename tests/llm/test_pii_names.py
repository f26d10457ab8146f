"""People and things that the code's lists don't have: how many are found, and how many left alone."""

from __future__ import annotations

from ratefield.llm import pii

GIVEN = """Keisha Kwame Barack Siobhan Mateus Dmitri Angela Lionel Nelson Ngozi Chimamanda Aoife Saoirse Bjorn Astrid Sigrid Torsten Gunnar Wolfgang Heinrich Friedrich Johann Ludwika Zbigniew Agnieszka Katarzyna
Bogdan Ion Mihai Razvan Zoltan Istvan Ferenc Gyorgy Milan Vaclav Jaroslav Zdenka Goran Slobodan Dusan Ljubica Vlado Mirjana Elif Mehmet Ayse Emre Deniz Orhan Rustam Aigul Nursultan Tenzin Sonam Karma Rabindranath Indira
Sachin Virat Deepika Shashi Arundhati Salman Benazir Imran Malala Sheikh Taslima Suu Nguyet Thanh Minh Siti Joko Megawati Corazon Ferdinand Lapu Hideo Haruki Akira Naomi Shinzo Yoko Soon Jae Hyun Minjun
Oyinkansola Sipho Thabo Winnie Desmond Wangari Haile Tirunesh Eliud Didier Romelu Thierry Zinedine Amelie Brigitte Gaspard Sylvain Benoit""".split()
FAMILY = """Washington Nkrumah Obama Gallagher Oliveira Shostakovich Merkel Messi Mandela Okonjo Adichie Murphy Ronan Ulvaeus Lindgren Undset Fings Sonsteby Goethe Heine Engels Strauss Wittgen Brzezinski Holland Janowska
Petrescu Tiriac Eminescu Lucescu Kodaly Szabo Puskas Ligeti Kundera Havel Seifert Podhajska Ivanisevic Milosevic Makavejev Maraic Divac Karanovic Shafak Oezil Kulin Belozoglu Gamze Pamuk Emomali Turganbay Abishev Gyatso Wangdi Dorjee Tagore Gandhian
Tendulkar Kohli Padukone Tharoor Royburman Rushdie Bhutto Zardari Yousafzai Hasina Nasrin Kyi Anhvu Trung Duong Nurhaliza Widodo Sukarno Aquino Magellan Lapuz Kojima Murakami Kurosawa Osaka Abeshi Onoda Myungwhan Parkhill Jinwoo Choihan
Braithwaite Khumalo Mbeki Madiki Tutuola Maathai Selassie Dibaba Kipchoge Drogba Lukaku Henryon Zidane Poulain Bardotte Monge Tessonne Magimelle""".split()
PEOPLE = [f"{g} {f}" for shift in (0, 31) for g, f in zip(GIVEN, FAMILY[shift:] + FAMILY[:shift], strict=False)][:200]

PLACES = """New York|Los Angeles|San Francisco|Las Vegas|Buenos Aires|Rio Grande|Hong Kong|Kuala Lumpur|Abu Dhabi|Tel Aviv|Addis Ababa|Sierra Leone|Sri Lanka|Costa Rica|Puerto Rico|North Carolina|South Dakota|West Virginia|East Anglia|Great Britain|
Cape Town|Port Elizabeth|Fort Worth|Mount Everest|Lake Geneva|Hyde Park|Golden Gate Bridge|Penn Station|Baker Street|Fifth Avenue|Sunset Beach|Rocky Mountains|Grand Canyon|Niagara Falls|Eiffel Tower|Buckingham Palace|Notre Dame Cathedral|British Museum|Tate Gallery|Bodleian Library|
Charlotte Airport|Sofia University|Lee County|Jackson Hole Village|Baton Rouge City|Salt Lake City|Saint Petersburg|Santa Fe|Sao Paulo|Old Trafford Stadium|Madison Square|George Washington Bridge|San Diego Zoo|Paris Province|Victoria Station|Austin College|Lincoln Memorial Hall|Houston Hospital|Savoy Hotel|Wembley Arena""".replace("\n", "").split("|")
FIRMS = """Johnson Controls|General Electric|General Motors|Baker Industries|Oracle Corporation|Morgan Holdings|Walker Partners|Delta Airlines|Philips Technologies|Ericsson Systems|Sterling Software|Barclays Bank|Deutsche Bank|Macy Group|Warner Records|Random House|
Cambridge Press|Washington Post|Chicago Tribune|Wall Street Journal|Time Magazine|Ford Foundation|Royal Society|Nobel Committee|Federal Reserve System|European Commission|National Guard|International Court|African Union|Asian Development Bank|Premier League|Davis Cup|Pulitzer Prize|Turner Prize|
Clayton Act|Moore Law|Versailles Treaty|Apache License|Public Domain Project|Manhattan Project|Kyoto Protocol|Noether Theorem|Down Syndrome|Parkinson Disease|Doppler Effect|Montessori Method|King James Version|Gutenberg Bible|Gettysburg Day|Woodstock Festival""".replace("\n", "").split("|")
THINGS = [*PLACES, *FIRMS, *(f"{f} {t}" for f, t in zip(FAMILY, ["Street", "Bridge", "University", "County", "Hospital", "Foundation", "Theatre", "Avenue", "Institute", "Museum"] * 10, strict=False))][:200]

OF_PEOPLE = ("Yesterday {} went home.", "we saw {} there", "a letter from {} about it", "{} said so.", "it was {}'s idea", "the report by {} is out", "he wrote to {} again", "and {} agreed")
OF_THINGS = ("We went to the {} there.", "it happened in {} then", "he works at {} now", "the {} is large", "near {} it rained", "{} is known for that.", "they left the {} early", "a trip across {} takes long")


def test_people_are_found_and_things_left_alone():
    listed = {w for names in pii.GIVEN.values() for w in names} | set(pii.FAMILY)
    assert len(PEOPLE) == len(set(PEOPLE)) == len(set(THINGS)) == len(THINGS) == 200 and listed.isdisjoint(" ".join(PEOPLE).split())
    s = pii.Surrogates()
    found = [p for i, p in enumerate(PEOPLE) if p not in pii.replace(OF_PEOPLE[i % 8].format(p), s)[0]]
    wrong = [t for i, t in enumerate(THINGS) if pii.replace(OF_THINGS[i % 8].format(t), s)[1]]
    assert len(found) >= 190, sorted(set(PEOPLE) - set(found))
    assert len(found) / (len(found) + len(wrong)) >= 0.95, wrong
    # the text around a name stays
    for i, p in enumerate(PEOPLE):
        left, right = OF_PEOPLE[i % 8].split("{}")
        new = pii.replace(OF_PEOPLE[i % 8].format(p), s)[0]
        assert new.startswith(left) and new.endswith(right)


def test_sentence_ends_and_repeats_are_no_names():
    s = pii.Surrogates()
    for clean in ("onea an A. Thou the", "it is. Ö. Der und", "auxouç. È. È. Avec du", "And And And And", "Und der Vertrag Und Die Sache", "Mit der Alten Sache ist der Neue Weg und die Gute Zeit nicht zu Ende", "stand. The End. Of Course", "Buy Now. Pay Later."):
        assert pii.replace(clean, s) == (clean, [])
    for named in ("by E. Hemingway here", "J. R. Tolkien wrote", "works of J. J. Abrams there", "田中太郎さんは", "我叫张小明，你好", "السيد محمد علي هنا"):
        assert len(pii.replace(named, s)[1]) == 1


def test_what_a_surrogate_keeps():
    s = pii.Surrogates()
    kinds = lambda text: [k for k, *_ in pii.replace(text, s)[1]]
    assert kinds("card 4111 1111 1111 1111 order 4111 1111 1111 1112") == ["card", "number"]
    new = s.of("name", "Иванова Мария Петровна")[0].split()
    assert new[0].endswith("ова") and new[2].endswith("овна") and pii._OF_NAME[new[1]] == ("cyrillic", "f")
    assert s.of("name", "Keisha")[0].endswith("a") and not s.of("name", "Kwame")[0].endswith("a")
    words = [a + b + e for a in "bdgk" for b in ("anov", "esk", "im") for e in ("", "a", "e")] + [a + b for a in ("Смирн", "Петр", "Иван", "Соболевск") for b in ("ов", "ова", "ий", "ая", "")]
    image = [s.of("name", w)[0] for w in words]
    assert len(set(image)) == len(words) and all(a != b and pii.Surrogates._ending(a.lower()) == pii.Surrogates._ending(b.lower()) for a, b in zip(words, image, strict=True))
    for address in ("10.0.0.5", "127.0.0.1", "192.168.1.7", "172.20.3.4", "203.0.113.9", "169.254.1.1", "239.1.1.1"):
        number = lambda v: sum(int(p) << 24 - 8 * i for i, p in enumerate(v.split(".")))
        other = s.of("ip", address)[0]
        bits = pii.Surrogates._reserved(number(address))
        assert other != address and number(other) >> 32 - bits == number(address) >> 32 - bits
    assert all(pii.Surrogates._reserved(sum(int(p) << 24 - 8 * i for i, p in enumerate(s.of("ip", f"8.8.{i}.8")[0].split(".")))) is None for i in range(200))
    uk, germany, home, coded = (s.of("phone", v) for v in ("+44 20 7946 0958", "+49 20 7946 0958", "269-555-3296", "+1 (269) 555-3296"))
    assert uk[1] != germany[1] and uk[2] != germany[2] and home[1:] == coded[1:]
    assert "STANBUL" not in s.of("name", "İSTANBUL")[0]
