"""Material for synthetic defects: how answerers decline, and how a text reports that someone else declined. Written here, not taken from any table."""

#: Fixed values by language: openings, refusals, reasons and closings of a declining answerer.
REFUSALS = {
    "en": (
        ["", "I'm sorry, but", "Sorry, but", "I apologize, but", "Sorry –", "Unfortunately,", "Regrettably,", "I'm afraid", "As an AI,", "As an AI model,", "As a language model,", "To be honest,", "Thank you for asking, but", "After reading this,", "My apologies:"],
        ["I can't assist with this request", "I cannot help with that", "I can't help with this", "I am unable to evaluate this response", "I am not able to judge this answer", "I must decline to rate this", "I have to decline", "I decline to answer", "I won't be able to give a score", "I will not grade this text", "I do not feel comfortable judging this content", "it is not possible for me to assess this", "this is not something I can judge", "my guidelines do not allow me to comment on this", "my rules prevent me from scoring this", "I would rather not give a verdict", "I refuse to compare these replies", "no verdict will be given by me", "I have to pass on this one", "I cannot comply with this", "I am not allowed to give an opinion here", "I can't take part in this", "I prefer to abstain from rating this", "I'm unable to provide an evaluation"],
        ["", "because it goes against my rules", "as it violates my policy", "since the topic is sensitive", "so please ask an expert", "because of my guidelines"],
        ["", "", "Please consult an expert instead.", "Is there anything else I can help with?", "Thank you for your understanding.", "I am happy to help with another question."],
    ),
    "de": (
        ["", "Es tut mir leid, aber", "Leider", "Entschuldigung,", "Tut mir leid:", "Als Sprachmodell", "Bedauerlicherweise"],
        ["dabei kann ich nicht helfen", "ich kann diese Antwort nicht bewerten", "diese Anfrage muss ich ablehnen", "dazu darf ich nichts sagen", "ich darf hierzu kein Urteil abgeben", "ein Urteil steht mir nicht zu", "ich möchte diesen Text nicht beurteilen", "das kann ich nicht beurteilen", "es ist mir nicht möglich, das einzuschätzen", "meine Regeln erlauben mir keine Bewertung", "ich bin nicht in der Lage, dies zu bewerten", "ich lehne eine Bewertung ab", "ich werde keine Note vergeben", "ich enthalte mich hier"],
        ["", "weil es gegen meine Regeln verstößt", "da das Thema heikel ist", "weil es meinen Richtlinien widerspricht"],
        ["", "", "Vielen Dank für Ihr Verständnis.", "Bitte fragen Sie eine Fachperson.", "Gern helfe ich bei einer anderen Frage."],
    ),
    "es": (
        ["", "Lo siento, pero", "Lamentablemente,", "Disculpe,", "Perdón, pero", "Como modelo de lenguaje,", "Desafortunadamente,"],
        ["no puedo ayudar con esto", "no puedo evaluar esta respuesta", "debo rechazar esta petición", "me niego a dar una nota", "no estoy en condiciones de valorar esto", "prefiero no juzgar este texto", "no me es posible emitir un juicio", "mis normas no me permiten opinar", "no se me permite dar un veredicto", "tengo que abstenerme de valorar", "no voy a puntuar esta respuesta", "debo negarme a responder"],
        ["", "porque va contra mis normas", "ya que el tema es delicado", "porque infringe mis reglas"],
        ["", "", "Gracias por su comprensión.", "Consulte a un especialista.", "Con gusto respondo otra pregunta."],
    ),
    "fr": (
        ["", "Je suis désolé, mais", "Désolé,", "Malheureusement,", "Je regrette, mais", "En tant que modèle de langue,", "Pardon, mais"],
        ["je ne peux pas vous aider", "je ne peux pas évaluer cette réponse", "je dois refuser cette demande", "je dois décliner", "je préfère ne pas juger ce texte", "je m'abstiens de noter", "il ne m'est pas possible de donner un avis", "mes règles ne me permettent pas d'évaluer ceci", "je ne suis pas autorisé à me prononcer", "je refuse de comparer ces réponses", "je ne donnerai pas de note", "je ne suis pas en mesure de répondre"],
        ["", "car cela va contre mes règles", "parce que le sujet est sensible", "car cela enfreint mes consignes"],
        ["", "", "Merci de votre compréhension.", "Veuillez consulter un spécialiste.", "Je répondrai volontiers à une autre question."],
    ),
    "id": (
        ["", "Maaf,", "Mohon maaf,", "Sayangnya", "Sebagai model bahasa,", "Dengan menyesal,"],
        ["saya tidak dapat membantu", "saya tidak bisa menilai jawaban ini", "saya harus menolak permintaan ini", "saya tidak diizinkan memberi penilaian", "saya lebih memilih tidak menilai teks ini", "hal ini tidak bisa saya nilai", "aturan saya tidak mengizinkan saya berkomentar", "saya tidak akan memberi skor", "saya tidak boleh memberi pendapat", "penilaian ini di luar wewenang saya", "saya menolak memberi nilai"],
        ["", "karena melanggar aturan saya", "karena topiknya sensitif", "karena bertentangan dengan pedoman saya"],
        ["", "", "Terima kasih atas pengertian Anda.", "Silakan bertanya kepada ahli.", "Saya senang membantu pertanyaan lain."],
    ),
    "ru": (
        ["", "Извините, но", "К сожалению,", "Простите, но", "Прошу прощения,", "Сожалею, но", "Как языковая модель,"],
        ["я не могу помочь с этим", "я не могу оценить этот ответ", "я вынужден отклонить этот запрос", "я отказываюсь давать оценку", "мне нельзя высказывать мнение", "я не в состоянии судить об этом", "мои правила не позволяют мне это оценивать", "я не буду выносить решение", "я предпочту не оценивать этот текст", "оценку здесь я дать не могу", "я должен воздержаться от ответа"],
        ["", "так как это нарушает мои правила", "потому что тема деликатная", "поскольку это против моих правил"],
        ["", "", "Спасибо за понимание.", "Обратитесь к специалисту.", "Я с радостью отвечу на другой вопрос."],
    ),
}

#: Sentences that report or discuss another's refusal; the answerer goes on judging.
REPORTS = {
    "en": ["The reply says it cannot answer, which is honest.", "The response refuses to answer the question.", "The assistant wrote \"I can't help with that\", which fits the request.", "The answer states that it is unable to check the figures.", "A refusal would have been wrong here.", "It declines one part of the task and answers the rest.", "The second reply simply refuses, and that costs it points.", "The text apologises once, which was not needed.", "The assistant said “I am sorry, but I must decline”, and the rubric accepts that."],
    "de": ["Die Antwort sagt, sie könne dazu nichts sagen.", "Der Text lehnt die Frage ab, was hier falsch wäre.", "Eine Ablehnung wäre hier falsch gewesen.", "Der Assistent schrieb „Dabei kann ich nicht helfen“, was passt."],
    "es": ["La respuesta dice que no puede contestar, y eso es honesto.", "Una negativa habría sido un error aquí.", "El asistente escribió «No puedo ayudar con eso», lo cual es razonable."],
    "fr": ["La réponse dit qu'elle ne peut pas répondre, ce qui est honnête.", "Un refus aurait été une erreur ici.", "L'assistant a écrit « Je ne peux pas vous aider », ce qui convient."],
    "id": ["Jawaban itu mengatakan tidak dapat menjawab, dan itu jujur.", "Penolakan akan keliru di sini.", "Asisten menulis “Saya tidak dapat membantu”, dan itu wajar."],
    "ru": ["Ответ сообщает, что не может этого проверить, и это честно.", "Отказ был бы здесь ошибкой.", "Помощник написал «Я не могу помочь», и это уместно."],
}
