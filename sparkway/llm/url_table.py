"""A small labelled table of urls, written by hand for the URL filter: block (spam, gambling, adult, pirated or phishing pages) or allow.

Some are bad by host, some by path on a host that has both kinds; among those to allow are hosts
and paths that hold parts of bad words.
"""

BLOCK = """
http://cheap-viagra-online.biz/order
http://www.best-casino-bonus.info/
http://pillsdirect24.com/buy/no-prescription
http://hot-singles-near-me.com/join
http://xxxvideos-hd.tube/watch/8812
http://payday-loans-now.co/apply
http://replica-watches-outlet.org/rolex
http://free-bet-tips.com/today
http://poker-freeroll.club/register
http://online-slots-777.com/play
http://adultcams.live/room/17
http://warez-download.ws/full-crack
http://keygen-crack-serial.com/photoshop
http://secure-paypa1-login.com/verify
http://account-update-appleid.info/signin
http://win-iphone-free.xyz/claim
http://weightloss-miracle-pills.com/trial
http://crypto-doubler.io/deposit
http://escorts-in-town.com/girls
http://buy-followers-fast.com/instagram
http://cialis-generic-store.com/cart
http://lottery-winner-claims.org.ru/prize
http://torrent-movies-free.to/dl
http://spamlinks.farm/page/1
http://sexchat24.com/
http://betting-odds-pro.net/bonus
http://cheapmeds-pharmacy.ru/
http://fast-cash-advance.us/apply-now
http://make-money-from-home.biz/signup
http://roulette-strategy-win.com/
http://hackedaccounts.shop/dump
http://nude-celebs.pics/gallery
http://fakehandbags-outlet.cn/gucci
http://jackpot-city-spins.com/free-spins
http://megaslots.bet/login
http://viagrapills.store/checkout
http://linkfarm-seo.com/backlinks
http://phish-bank-login.com/confirm
http://malware-scan-alert.com/download.exe
http://clickbait-news-wow.com/you-wont-believe
http://adult-toys-x.com/sale
http://dating-hookup-adult.com/profile
http://xporn-free.org/
http://bets4you.com/live
http://casino-royal-spins.net/
http://spam-blast-mailer.com/
http://cheap-bets-pills.com/
http://www.adult-xx-zone.com/
http://freepills-trial.com/
http://content-farm-spam.com/a/1
http://casino-games-online.com/play
http://www.live-casino-poker.com/bonus
http://online-poker-casino.biz/
http://viagra-cialis-pharmacy.com/order
http://cheap-cialis-viagra.org/
http://diet-pills-online.com/buy
http://cheap-pills-order.com/shop
http://sports-betting-bonus.com/
http://bets-and-odds.net/betting
http://free-porn-tube.com/videos
http://porn-cams-live.com/xxx
http://xxx-adult-videos.com/
http://adult-dating-sex.com/girls
http://sex-cams-online.org/
http://slots-jackpot-casino.com/spins
http://jackpot-lottery-online.com/winner
http://payday-cash-loans.com/apply
http://instant-loans-cash.net/payday
http://torrent-warez-crack.com/download
http://crack-keygen-torrent.com/
http://replica-handbags-cheap.com/
http://spam-email-lists.com/buy
http://www.example.com/casino/free-spins
http://www.example.org/buy-cheap-viagra-online
http://www.example.net/poker/bonus-code.html
http://www.example.com/t/escort-girls-cheap
http://www.example.org/x/crack-serial-keygen.zip
http://www.example.net/replica-rolex-watches/
http://www.example.com/~u/xxx-porn-videos/
http://www.example.org/user/payday-loans-online
http://www.example.net/free-iphone-winner/claim.php
http://www.example.com/betting/odds/free-bets
http://www.example.org/cialis-no-prescription.html
http://www.example.net/adult/nude/gallery.html
http://www.example.com/warez/full-movie-torrent
http://www.example.org/login/paypa1/verify-account
http://www.example.net/slots/jackpot/play-now
http://www.example.com/weight-loss-pills/order
http://www.example.org/online-casino-review
http://www.example.net/sexcam/live
http://www.example.com/lottery-prize/claim-now
http://www.example.org/make-money-fast-home
http://www.example.net/casino/poker.html
http://www.example.com/viagra/buy
http://www.example.org/adult-x/videos
http://www.example.net/spam/links/farm.html
http://www.example.com/free-bets/spins
http://www.example.org/cheap-pills/cart
"""

ALLOW = """
http://www.north-harbour.com/ferries
http://m.daily-observer.com/weather/today
http://blog.quiet-kitchen.com/bread
http://therapists-register.org/find
http://southern-orchestra.org/concerts
http://www.threadandneedle.com/patterns
http://www.thistle-farm.com/cheese
http://mountain-rescue.org/training
http://www.other-worlds.org/reviews
http://the-herring-gull.com/birds
http://www.thermal-insulation.com/walls
http://blog.their-garden.org/seeds
http://m.streetmap.com/en/12
http://www.tidetables.com/en/340
http://notebook.org/es/7
http://blog.lanterns.com/fr/19
http://www.tenthousandsteps.com/en/56
http://harvesters.org/de/204
http://www.riverside-library.org/opening-hours
http://museum-of-science.com/visit/tickets
http://gardeners-almanac.com/roses/pruning
http://freedom-of-information.gov/request
http://farmersmarket-guide.net/stalls
http://shop.cheapest-flights.com/london
http://adulteducation-college.com/courses
http://essexcountycouncil.gov/bins
http://middlesex-hospital.org/wards
http://betterhealth.org.au/diet
http://alphabets-for-kids.com/letters
http://pillsbury-bakery.com/recipes
http://spamalot-musical.com/tickets
http://specialist-orthopaedics.com/clinic
http://socialistreview.net/archive/1998
http://casino-heritage-architecture.com/history
http://slotcar-racing-club.org/events
http://pokerwork-craft.com/wood-burning
http://freelance-writers.net/guidelines
http://farmland-birds.org.uk/survey
http://newsroom.university.edu/releases
http://weather-station.com/forecast/weekly
http://city-transit.gov/timetable
http://opensource-docs.dev/install
http://history-of-maps.org/atlas
http://bookshop-corner.com/fiction
http://chess-openings.com/sicilian
http://recipes-from-home.com/soup/lentil
http://local-theatre.net/season
http://astronomy-club.com/meteor-showers
http://healthservice.gov/vaccines
http://community-choir.org/rehearsals
http://bridges-and-tunnels.com/tolls
http://cycling-routes.net/coast
http://parish-records.com/1841
http://mathsforum.org/algebra
http://kennel-society.com/breeds/terrier
http://village-school.net/term-dates
http://kitchen-garden.com/tomatoes
http://violin-makers.com/strings
http://photography-basics.com/aperture
http://thermal-springs.org/baths
http://steamrailway.com/timetable
http://poetry-archive.net/sonnets
http://legal-advice-centre.com/tenancy
http://cheapside-london.org/streets
http://freeman-stationery.com/paper
http://beta-software-testers.com/join
http://totalbets-analysis.edu/probability
http://loanwords-dictionary.com/english
http://sussex-downs.net/walks
http://hen-and-chicken.com/coops
http://northern-lights.org/aurora
http://readings.com/whitman
http://www.example.net/
http://www.example.com/2019/05/garden-notes
http://www.example.org/politics/budget.html
http://www.example.net/t/bicycle-repair
http://www.example.com/guide/install.html
http://www.example.org/books/history
http://www.example.net/~u/astronomy/
http://www.example.com/user/editing-help
http://www.example.org/img/logo.png
http://www.example.net/calendar/week
http://www.example.com/essays/on-walking.html
http://www.example.org/holiday/beach.html
http://www.example.net/reports/annual.pdf
http://www.example.com/login/help
http://www.example.org/timeslots/booking
http://www.example.net/pillows-and-bedding
http://www.example.com/freedom-of-speech
http://www.example.org/adulthood/psychology
http://www.example.net/alphabet/letters
http://www.example.com/spare-time-reading
http://www.example.org/gallery/paintings.html
http://www.example.net/members/meeting
http://www.example.com/farm-shop/visits
http://www.example.org/census/tables.html
http://www.example.net/en/12
http://www.example.com/de/305
http://www.example.org/fr/77
http://www.example.net/es/1004
http://www.example.com/en/58
http://www.example.org/de/640
"""
