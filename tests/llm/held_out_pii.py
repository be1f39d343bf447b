"""Sentences with personal information, written by hand and apart from the labelled table: (text, kinds that occur).

No clause, name, street or number of them is in the table of ``pii_examples``, nor in the tables of the driver.
"""

SENTENCES = [
    # names
    ("The winner was introduced by Nathaniel Osei yesterday", {"name"}),
    ("The winner was announced by Kwame Boateng yesterday", {"name"}),
    ("our editor is called Lucia Fernandez", {"name"}),
    ("In memory of Helen Brooks", {"name"}),
    ("Happy birthday Samuel Adeyemi", {"name"}),
    ("We spent the afternoon with Gordon Fletcher at the beach", {"name"}),
    ("Huge applause for Marianne Dubois, what a night", {"name"}),
    ("The camera belongs to Oliver Stanton", {"name"}),
    ("Mrs. Pickering still bakes the bread herself", {"name"}),
    ("Dr. Leopold Gruber explains why it rains", {"name"}),
    ("I asked Tobias Kern and he just laughed", {"name"}),
    ("subtitles: Ingrid Solheim", {"name"}),
    ("Die Idee kam von Sabine Richter", {"name"}),
    ("Heute kocht Herr Wagner für alle", {"name"}),
    ("La receta es de Francisco Ibarra", {"name"}),
    ("hoy cocinamos con Pilar Echeverría en casa", {"name"}),
    ("La chanson est écrite par Baptiste Girard", {"name"}),
    ("O vídeo foi gravado por Henrique Tavares", {"name"}),
    ("Автор текста Николай Васильев", {"name"}),
    ("Videoyu Murat Aksoy çekti", {"name"}),
    ("Foto oleh Rizky Pratama", {"name"}),
    ("HARRINGTON, Paul won the second set", {"name"}),
    # email
    ("If anything breaks, tell webmaster@harbourlight.example", {"email"}),
    ("press kit? just ask newsroom@bluecrate.test", {"email"}),
    ("My mailbox j.weatherby@post.lumen.test is always open", {"email"}),
    ("Schreib einfach an kontakt@ofenfrisch.example", {"email"}),
    ("puedes escribirnos: hola@tresnubes.test", {"email"}),
    ("toutes vos idées ici : idees@petitsuisse.example", {"email"}),
    ("свяжитесь с нами: hello@severnoe.test", {"email"}),
    ("sticker orders to shop (at) paperfox (dot) example", {"email"}),
    ("send fan art to FANART@KITEMAKERS.TEST", {"email"}),
    ("mail us: team [at] quietroom dot test", {"email"}),
    ("bize destek@gunesli.example yazabilirsiniz", {"email"}),
    # phone
    ("Bookings by phone only, +44 20 7946 0958", {"phone"}),
    ("the bakery answers at (415) 555-2671", {"phone"}),
    ("give us a shout on 07911 123456", {"phone"}),
    ("Rückfragen unter 030 901820 4455", {"phone"}),
    ("para reservas marca el +34 612 345 678", {"phone"}),
    ("rappelle-moi au 06 12 34 56 78", {"phone"}),
    ("zap da loja +55 11 98765-4321", {"phone"}),
    ("наберите +7 912 345 67 89", {"phone"}),
    ("bilgi hattı 0212 555 12 34", {"phone"}),
    ("WA admin 0812-3456-7890", {"phone"}),
    ("studio landline: 212-555-7788", {"phone"}),
    # id numbers
    ("oops, my SSN 123-45-6789 was readable", {"id_number"}),
    ("Please blur passport no. KL4471902 next time", {"id_number"}),
    ("He read out his NI number QW 12 34 56 B live", {"id_number"}),
    ("Steuer-ID 12 345 678 901 steht auf dem Zettel", {"id_number"}),
    ("no enseñes tu DNI 45871236K en directo", {"id_number"}),
    ("meu CPF 321.654.987-00 vazou", {"id_number"}),
    ("the clerk typed Aadhaar 4567 8912 3456 twice", {"id_number"}),
    ("в кадре паспорт 4509 123456", {"id_number"}),
    ("TC kimlik 23456789012 görünüyor", {"id_number"}),
    ("driver licence GH552719K was in the bag", {"id_number"}),
    ("NIK 3175091204870003 ada di kartu itu", {"id_number"}),
    # addresses
    ("the workshop on 42 Baker Street near the bridge", {"address"}),
    ("Our bakery moved, now 18 Rosebery Avenue", {"address"}),
    ("Postcards welcome: P.O. Box 4417, Larkfield", {"address"}),
    ("the party is at 9 Pinewood Close", {"address"}),
    ("Der neue Proberaum: Lessingstraße 14", {"address"}),
    ("quedamos en Calle del Prado 27", {"address"}),
    ("on se retrouve 12 rue des Lavandes", {"address"}),
    ("o show é na Rua do Comércio, 455", {"address"}),
    ("встреча: ул. Речная, д. 8", {"address"}),
    ("kumpul di Jalan Kenanga No. 21", {"address"}),
    ("parcels: 305 Birchwood Lane, Apt 7", {"address"}),
    # nothing to hide
    ("the old harbour was quiet and the boats came back late", set()),
    ("10 tips for better bread, number 7 surprised me", set()),
    ("we sold 3,400 tickets in 2 hours", set()),
    ("Season finale of The Hollow Crown on Sunday", set()),
    ("City Marathon 2024: 42 km in the rain", set()),
    ("our order 4471-88-2031 never arrived", set()),
    ("follow @marta.cooks and @studio_lane for more", set()),
    ("recorded at 21:45:10 on 2023-11-05", set()),
    ("Das Wetter in den Bergen war herrlich", set()),
    ("mañana volvemos al mercado con mi abuela", set()),
    ("la mer était calme et le vent froid", set()),
    ("o jogo terminou 3-1 e a torcida cantou", set()),
    ("сегодня мы поём и танцуем до утра", set()),
    ("bu akşam çorba ve ekmek var", set()),
    ("kami pergi ke pasar pagi ini", set()),
    ("version 4.12.7 fixes the crash, 99% of you won’t notice", set()),
    ("the street was closed so we took the long road home", set()),
    ("It cost $1,299.00 and I regret nothing", set()),
    ("I will mark the day with a rose and some hope", set()),
    ("Chapter 12: The Lighthouse", set()),
    ("who else remembers the blue bicycle from the summer of 98", set()),
    ("full playlist at https://clips.example/list?id=20394857", set()),
]
