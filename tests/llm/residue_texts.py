"""Texts written for the tests of residue detection, apart from any table: one a line."""

RESIDUE = r"""
You must turn on JavaScript in order to use this application.
For full functionality of this site it is necessary to enable JavaScript.
JavaScript seems to be disabled in your browser. You must have JavaScript enabled to utilize this website.
This page requires JavaScript. Please enable it in your browser settings and reload.
We're sorry but this app doesn't work properly without JavaScript enabled.
Your browser does not support JavaScript!
Please enable cookies in your browser to sign in.
Cookies must be enabled to use the shopping cart.
Your browser is blocking cookies. Allow cookies and try again.
You are using an outdated browser. Please upgrade your browser to improve your experience.
This site is not compatible with Internet Explorer. Please switch to a supported browser.
Looks like your browser has scripts blocked. Enable scripts to load comments.
Checking your browser before accessing the site. Please enable JavaScript and cookies to continue.
Notre site nécessite JavaScript. Merci d'activer JavaScript dans votre navigateur.
JavaScript ist in Ihrem Browser deaktiviert. Bitte aktivieren Sie JavaScript.
Por favor, habilite JavaScript en su navegador para ver este contenido.
Para visualizar este site, habilite o JavaScript no navegador.
Per utilizzare questo sito è necessario abilitare JavaScript nel browser.
Deze website werkt alleen als JavaScript is ingeschakeld in uw browser.
Для работы сайта включите JavaScript в настройках браузера.
您的浏览器未启用 JavaScript，请启用后刷新页面。
Dear [Hotel Name], thanks for your stay with us last week.
Dear {{ customer.first_name }}, your parcel has left our depot.
Hello ${user}, your balance is due on Friday.
Hi %FIRSTNAME%, we miss you at the club.
Welcome back, *|FNAME|*! Here is what happened this week.
The meeting with <<client>> starts at nine in the large room.
Thank you for contacting [Company Name]. We will reply within two days.
This agreement is made between [PARTY A] and [PARTY B] on the date below.
Please send the signed copy to <YOUR_EMAIL> before Friday.
I am writing to apply for the [Job Title] position at your firm.
Invoice {invoice_number} is overdue since last month.
<%= @user.name %> has invited you to join the board.
The order {% order_id %} was shipped this morning.
Hello undefined, welcome to your dashboard.
You have NaN new messages and one friend request.
Hello null, your trial ends today.
Total due: [object Object] by the end of the month.
The sum of the column is #REF! and the average is #DIV/0!
Signed on ______ by the tenant and ______ by the landlord.
The patient XXXX was admitted on XX/XX/XXXX with a fever.
Meet us at [insert address here] next Tuesday.
Our shop is open from [opening time] to [closing time] every weekday.
TODO: write the introduction. The second chapter covers the harvest.
The contact for this matter is @@contact_name@@ in the north office.
Kind regards, [Your Name]
Sehr geehrter Herr [Nachname], vielen Dank für Ihre Anfrage.
Bonjour [prénom], votre commande est prête.
Estimado {nombre_cliente}, su pedido ha sido enviado.
Our offices in __CITY__ will close at noon on Friday.
Sold {0} units to {1} customers in the last quarter.
Your text goes here. Your text goes here. Your text goes here.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation.
Add your content here. Add your heading here. Add your subtitle here.
This is a sample page. Replace this text with your own.
This is placeholder text. It will be replaced before launch.
Insert description here
Enter your title here. Click to edit this text.
Type something here to describe your product.
Dummy text for the footer. Dummy text for the sidebar.
Double-click here to add text
Section intro goes here
bla bla bla bla bla
test test test test test
asdf asdf qwer asdf qwer zxcv asdf
Hier steht Ihr Text. Hier steht Ihr Text.
Dies ist ein Blindtext. An ihm lässt sich vieles über die Schrift ablesen.
Texte à compléter. Votre texte ici.
Escriba su texto aquí. Texto de ejemplo.
Inserisci qui il tuo testo. Testo di esempio.
xxx xxx xxx xxx xxx xxx
foo bar baz foo bar baz foo bar
404 Not Found
403 Forbidden. You don't have permission to access /admin on this server.
500 Internal Server Error nginx/1.18.0
Error 502 Bad gateway. The web server reported a bad gateway error.
HTTP 429: Too Many Requests
Sorry, the page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.
Oops! That page can't be found. It looks like nothing was found at this location.
The requested URL was not found on this server.
This page isn't working right now. If the problem continues, contact the site owner.
Access Denied. You don't have permission to access this resource.
Your session has timed out. Please log in again.
This site can't be reached. The server took too long to respond.
We are currently undergoing scheduled maintenance. Please check back later.
Service temporarily unavailable. Please try again in a few minutes.
Our systems have detected unusual traffic from your computer network.
Please complete the security check to access the site. Prove you are not a robot.
Something went wrong. Please try again later.
An unexpected error has occurred. Our team has been notified.
Diese Seite existiert nicht mehr. Zurück zur Startseite.
La page que vous cherchez est introuvable.
Lo sentimos, la página que busca no existe.
页面未找到，请返回首页。
Segmentation fault (core dumped)
TypeError: Cannot read properties of undefined (reading 'map')
Traceback (most recent call last): File "main.py", line 4, in <module> KeyError: 'id'
Exception in thread "main" java.lang.NullPointerException at com.acme.Main.run(Main.java:14)
Fatal error: Uncaught Error: Call to undefined function get_header() in /home/site/index.php:3
Warning: Undefined variable $title in /var/www/html/page.php on line 18
Notice: Undefined index: user in C:\xampp\htdocs\login.php on line 7
panic: runtime error: index out of range [3] with length 3
goroutine 1 [running]: main.main() /tmp/prog.go:9 +0x1d
ERROR 1064 (42000): You have an error in your SQL syntax; check the manual
SQLSTATE[HY000] [2002] Connection refused
Error establishing a database connection
Unhandled exception. System.InvalidOperationException: Sequence contains no elements at Program.Main()
npm ERR! code ELIFECYCLE
bash: foo: command not found
ORA-00942: table or view does not exist
java.sql.SQLException: No suitable driver found at java.sql.DriverManager.getConnection(DriverManager.java:689)
""".strip().splitlines()

HARMLESS = r"""
Write a short mail-merge tutorial that uses the tag {{last_name}} as an example.
The config key ${retries} is read from the shell at start-up.
In this template language the variable {{ total }} is replaced by the sum of the cart.
Explain to a beginner what the placeholder %s means in a format string.
The expression ${HOME} expands to the path of the home directory.
In Jinja, the syntax {{ name }} prints a variable and {% if %} starts a condition.
The delimiter {{ opens an expression in many template engines.
Explain how Mustache treats the tag {{#items}} inside a list.
JavaScript was created in ten days and first shipped with a browser in 1995.
Our course teaches JavaScript and Python to adults who never wrote a program.
Explain how to enable JavaScript in a browser for older relatives.
Describe why some users disable JavaScript and what breaks when they do.
The survey asked visitors whether they allow cookies on news sites.
Grandma's cookies need butter, sugar and a hot oven.
Write an essay on how browsers store cookies and why regulators care.
A good notice tells users politely that the site needs JavaScript.
The law says that a site must ask before it stores cookies.
Which browser was the most popular in Brazil last year?
The play's script needs a stronger second act before rehearsals start.
We turned on the lights and the browser of the library closed for the day.
The team wrote a script that renames photos by date.
He enabled two-factor sign-in for all accounts before the audit.
The patch adds support for cookies with the SameSite attribute.
Summarize the release notes of the browser in three sentences.
Please compare how three portals word their error pages.
Explain the difference between a 404 and a 410 response to a new developer.
What does HTTP status 503 mean and when should a server send it?
A 404 error tells the client that the resource was not found.
The budget of 404 crowns was not found to be excessive.
Room 500 and room 502 are on the fifth floor behind the gateway.
The lost keys were not found in the garden.
The page on Roman roads was written by two students.
He could not find the page he had marked in the old atlas.
Access to the archive is denied to visitors without a card.
The expedition went wrong when the storm broke the mast.
Something went wrong with the oven, so dinner was late.
If the pump fails again, contact the owner of the farm.
The session of the council expired at midnight without a vote.
Traffic on the ring road was unusual for a Sunday.
The museum is closed for maintenance until spring, the paper reports.
The robot has to prove that it can sort apples by colour.
Verify that the human resources form is complete before you file it.
Draft an apology email for customers who saw a maintenance page last night.
Write a friendly message for our 404 page that sends readers home.
The internal report of the server team lists no error.
A traceback in Python lists the calls that led to an exception.
Explain when Java throws a NullPointerException and how to avoid it.
The lecture compares segmentation faults with other memory errors.
Why does Python raise a KeyError instead of returning None?
The surgeon explained the fault and the segmentation of the scan.
Describe in plain words what an exception handler does.
The syntax error in his Latin sentence amused the class.
The connection to the ferry was refused to late passengers.
Database design is taught in the second year.
The command was not found in the old manual, so we wrote our own page.
Lorem ipsum is the usual name for dummy text; explain where it comes from.
Explain why designers use lorem ipsum in mock-ups.
The history of dummy text goes back to Cicero, as the article says.
The placeholder in the search box should say what can be searched.
Teach pupils what a placeholder is in an equation.
Her place in the choir was filled by a friend.
The sample of soil was dry, and the text of the label had faded.
Replace the filter of the pump every year with a new one.
Click the button twice to open the valve, then describe the sound.
Bla bla bla was all he heard during the speech.
We ran the test, and the test passed.
Testing, testing, the microphone works.
Blah, she said, and left the room.
The dolor of the poem is found in its last line.
Add your name to the list by the door.
Enter the hall by the side door and describe what you see.
Your ticket is valid here until ten.
Type the letter on the old machine and keep a copy.
Insert the card with the chip facing down.
The set {a, b, c} has three members.
In the list [1, 2, 3] the second entry is 2.
He wrote [sic] after the odd spelling, see note [14].
The interval [0, 1] contains its end points.
Use the <b> element sparingly and prefer <strong> for meaning.
In the report the array x[i] holds the yield of field i.
Mail the form to office@example.org or call before noon.
The hashtags #harvest and #apples were used most often.
The discount of 20% applies to 3% of all orders.
Rates rose from 5 % to 7 % between the two surveys.
The price is $5 in the shop and $6 at the door.
She paid $40 for the coat and $12 for the hat.
Follow @lena and @tomas for updates from the island.
The method __init__ is called when an object is made.
Set the variable max_rows to ten and run the query again.
The file path /etc/hosts is read when the computer starts.
The ratio a|b means that a divides b.
The kernel of the map is {0}, so the map is one to one.
He asked me: what??? and I had no answer.
The limit of the function is undefined at zero.
Behaviour is undefined when the index is negative, the standard says.
In floating point, NaN is not equal to itself.
The null hypothesis was rejected at the five percent level.
TODO lists help some people and stress others.
The Todo board has forty cards, close the stale ones.
Rows with a missing date are shown as N/A in the table.
Columns marked n/a were left out of the average.
The Roman numeral XXX stands for thirty.
The (optional) appendix lists all members of the choir.
As noted in [Smith 2004], the effect is small.
The actor [laughs] and sits down next to the piano.
The <title> element should be short and say what the page is about.
Please enable the alarm before you leave the building.
The nurse must require a signature before the visit continues.
Allow the dough to rest, then continue with the filling.
The application of the cream requires clean hands.
You need to activate the membership card at the desk.
Your account manager will try again to call you on Monday.
Try the soup again later when it has cooled.
The site of the old mill is closed to visitors.
We are sorry that the train was late yesterday.
The address you gave us was correct, thank you.
""".strip().splitlines()
